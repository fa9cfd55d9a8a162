"""License scans by sentence rules.

A text's sentences are normalised (letters, digits, dots within numbers; one space; lower case) and searched for known
licence sentences, of which one may hold several; the sequence of their identifiers is matched against licence rules,
in order, and what a rule has taken is not matched again. Only ``.``, ``!``, ``?`` before white space and blank lines
end a sentence: a line break is a space in a known sentence, and so are ``:`` and ``;``. An open sentence (``.*``)
takes what follows up to the next known one, a named identifier (SPDX) the rest of its line, any other one its lines.
Lines beside them, and sentences without a known one, are ``UNKNOWN`` if they speak of a licence, once for each part
between ``:`` or ``;``. A reference that a word of negation precedes ("not released under ...") is ``NOT``, and no rule
has that. Of an SPDX expression each licence is an identifier of its own, whatever joins them; names that are not known
are ``SPDX:LicenseRef``.

Null and empty texts have no sentences. Texts are read whole; those without a trigger word, which every known
sentence holds, are not looked at further. One row for each row of the input, repeated ones too, in which only doc_id
and text are looked at; doc_id may be null.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import parts, slim

#: How a licence is referred to.
_REF = r"((dual )?licensed|released|distributed|available|published|provided|covered|licenses this file to you|redistribute it and or modify it) (under|by|according to)( the)?( terms (and conditions )?of)?( either)?( the)? "
#: Names of licences in references, as patterns, with their identifiers; the more special first.
_NAMES = [
    ("Apache20", r"apache( software)?( license)?( ?version| ?v)? ?2(\.0)?( license)?( the license)?"),
    ("MIT", r"(mit|expat)( x11)? licen[sc]e"),
    ("ISC", r"isc licen[sc]e"),
    ("BSD2", r"((simplified|freebsd|2 clause) bsd|bsd 2 clause( simplified)?) licen[sc]e"),
    ("BSD3", r"((new|modified|revised|3 clause) bsd|bsd 3 clause( new or revised)?) licen[sc]e"),
    ("MPL20", r"(mozilla public license|mpl)( ?version| ?v)? ?2\.0"),
    ("EPL20", r"(eclipse public license|epl)( ?version| ?v)? ?2\.0"),
    ("EPL10", r"(eclipse public license|epl)( ?version| ?v)? ?1\.0"),
    ("Boost", r"(boost software license|bsl)( ?version| ?v)? ?1\.0"),
    ("Zlib", r"zlib( libpng)? licen[sc]e"),
    ("Unlicense", r"unlicense"),
    ("CC0", r"(creative commons )?(cc0|cc zero)( 1\.0)?( universal)?"),
]
#: The GNU family: identifier, name, versions.
_GNU = [
    ("AGPL", r"(gnu )?(affero general public license|agpl)", ("3",)),
    ("LGPL", r"(gnu )?((lesser|library) general public license|lgpl)", ("2.1", "3", "2")),
    ("GPL", r"(gnu )?(general public license|gpl)", ("3", "2")),
]
#: Creative Commons elements with their names, and versions.
_CC = [("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by", "attribution")]
_CC_VERSIONS = ("4.0", "3.0", "2.0")
_LATER = r"( of the license)?( or)?( at your option)?( any)? later( versions?)?"


def _id(*words: str) -> str:
    return "".join(w.title().replace(" ", "").replace(".", "") for w in words)


#: Licence sentences, as patterns over normalised sentences, with their identifiers. Longer ones come
#: before those that they begin with.
SENTENCES = [
    ("ApacheNotUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("BoostPerm", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("MITPerm", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("ISCPerm", r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims all warranties.*"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty.*"),
    ("ZlibPerm", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented.*"),
    ("ZlibAltered", r"altered source versions must be plainly marked as such.*"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("AsIs", r"(the|this) software is provided (by the .{3,60} )?as is (without warranty of any kind|and any express or implied warranties).*"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("MPLSubject", r"this source code form is subject to the terms of the mozilla public license v 2\.0"),
    ("MPLCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("CC0Waived", r"to the extent possible under law .{0,80}has waived all copyright and related or neighbou?ring rights.*"),
    *[(f"EPL{v[0]}Made", rf"made available under the terms of the eclipse public license v(ersion)? ?{re.escape(v)}.*") for v in ("2.0", "1.0")],
    *[(f"{i}Free", rf"you can redistribute it and or modify it under the terms of the {name}( version [0-9.]+)? as published by the free software foundation.*") for i, name, _ in _GNU],
    *[(f"Either{_id(v)}", rf"either version {re.escape(v)}(\.0)? of the license or.*") for v in ("2.1", "3", "2")],
    *[(f"Only{_id(v)}", rf"version {re.escape(v)}(\.0)? of the license( only)?(?! or)") for v in ("2.1", "3", "2")],
    *[(f"{i}{_id(v)}{kind}", rf"{_REF}{name}( as published by the free software foundation)?( ?version| ?v)? ?{re.escape(v)}(\.0)?{rest}") for i, name, versions in _GNU for v in versions for kind, rest in (("Later", _LATER), ("Ref", "(?![0-9.]*[0-9])( only)?"))],
    *[(f"CC{_id(short, v)}", rf"{_REF}((creative commons|cc) )({short}|{name}) {re.escape(v)}( international| unported)?") for short, name in _CC for v in _CC_VERSIONS],
    *[(f"{i}Ref", _REF + name) for i, name in _NAMES],
    ("SPDX", r"spdx license identifier"),
    ("BSDRedist", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r"neither the name of.*"),
]
#: Names of licences in SPDX expressions.
SPDX_IDS = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1".split()
_VERSION = {"2.1": "2.1", "3": "3.0", "2": "2.0"}
#: Licence rules, tried in this order, over sequences of identifiers ("?" marks one that may be missing).
RULES = [
    ("Apache-2.0", "Apache20Ref ApacheNotUse ApacheCopy ApacheAsIs?"), ("Apache-2.0", "Apache20Ref"),
    ("MIT", "MITPerm MITNotice AsIs?"), ("MIT", "MITRef"), ("ISC", "ISCPerm ISCAsIs?"), ("ISC", "ISCRef"), ("BSL-1.0", "BoostPerm AsIs?"), ("BSL-1.0", "BoostRef"),
    ("Zlib", "ZlibAsIs? ZlibPerm ZlibOrigin ZlibAltered? ZlibNotice?"), ("Zlib", "ZlibRef"), ("Unlicense", "UnlicenseFree UnlicenseAnyone?"), ("Unlicense", "UnlicenseRef"),
    ("MPL-2.0", "MPLSubject MPLCopy?"), ("MPL-2.0", "MPL20Ref"), ("EPL-2.0", "EPL2Made"), ("EPL-1.0", "EPL1Made"), ("EPL-2.0", "EPL20Ref"), ("EPL-1.0", "EPL10Ref"), ("CC0-1.0", "CC0Waived"), ("CC0-1.0", "CC0Ref"),
    *[(f"{i}-{_VERSION[v]}-or-later", f"{i}Free Either{_id(v)}") for i, _, versions in _GNU for v in versions],
    *[(f"{i}-{_VERSION[v]}-only", f"{i}Free Only{_id(v)}") for i, _, versions in _GNU for v in versions],
    *[(f"{i}-{_VERSION[v]}{end}", f"{i}{_id(v)}{kind}") for i, _, versions in _GNU for v in versions for kind, end in (("Later", "-or-later"), ("Ref", ""))],
    *[(f"CC-{short.upper().replace(' ', '-')}-{v}", f"CC{_id(short, v)}") for short, _ in _CC for v in _CC_VERSIONS],
    ("BSD-3-Clause", "BSDRedist BSDSource BSDBinary BSDEndorse AsIs?"), ("BSD-2-Clause", "BSDRedist BSDSource BSDBinary AsIs?"), ("BSD-3-Clause", "BSD3Ref"), ("BSD-2-Clause", "BSD2Ref"),
    *[(x, f"SPDX:{x}") for x in [*SPDX_IDS, "LicenseRef"]],
]
#: Words before a reference that deny it.
_NOT = re.compile(r"\b(not|never|no longer|nor|neither|isn t|wasn t|aren t|cannot be|without being)( \w+){0,2} $")
TRIGGER = re.compile(r"licen[sc]e|permission|copyright|redistribut|warrant|spdx|version|neither the name|compliance|released|distribut|available|published|provided|covered|misrepresented|altered|anyone is free|waived", re.I)
#: What speaks of a licence where no known sentence is found.
SPEAKS = re.compile(r"licen[sc]e|permission|copyright|redistribut|warrant|spdx|either version|neither the name|compliance", re.I)
_END, _JUNK = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n"), re.compile(r"[^0-9a-z.]+|\.(?![0-9])|(?<![0-9])\.")
#: In a normalised sentence a line break stays one, and ":" or ";" before white space is a form feed: _BREAK.
_BREAK = re.compile(r"[:;](?=\s)")
_GAP = r"[\s]"
_KNOWN = "|".join(f"(?P<{i}>{p.removesuffix('.*').replace(' ?', _GAP + '*').replace(' ', _GAP + '+')})" for i, p in SENTENCES)
_KNOWN = re.compile(rf"(?<![a-z0-9])(?:{_KNOWN})(?![a-z0-9])")
_OPEN = {i for i, p in SENTENCES if p.endswith(".*") and i != "SPDX"}
_LINE = re.compile(r"[\n\f]+")
#: Spelt out or joined up before a text is cut: 2+ is "2 or later", and the full stop of "v. 2" ends no sentence.
_PLUS, _ABBREVIATED = re.compile(r"(?<=[0-9])\+"), re.compile(r"\b(v|ver)\.(?=\s*[0-9])", re.I)
_MARKS, _SHOUT = re.compile(r"[#*$%&|<>]+"), re.compile(r"!!+(?=\s|$)")
_RULES = [(name, re.compile(r"(?<!\S)" + "".join(f"(?:{re.escape(s[:-1])} )?" if s.endswith("?") else f"{re.escape(s)} " for s in rule.split()))) for name, rule in RULES]
_FIRST = {rule.split()[0].removesuffix("?") for _, rule in RULES}
_NAMED = {_JUNK.sub(" ", x.lower()).strip(): x for x in SPDX_IDS}
_SPDX = re.compile(r"(?<![a-z0-9.])(?:(?P<id>" + "|".join(sorted(map(re.escape, _NAMED), key=len, reverse=True)) + r")(?P<later> or later)?|(?P<word>[a-z0-9.]+))(?![a-z0-9.])")


def expression(words: str) -> list[str]:
    """Identifiers of the licences of a normalised SPDX expression."""
    out, known, skip = [], True, False
    for m in _SPDX.finditer(words):
        word = m["word"]
        if word in ("or", "and", "with"):
            known, skip = True, word == "with"  # what follows "with" is an exception, no licence
        elif skip:
            continue
        elif m["id"]:
            name = _NAMED[m["id"]]
            later = name.removesuffix("-only") + "-or-later"
            out.append(f"SPDX:{later if m['later'] and later in SPDX_IDS else name}")
            known = False
        elif known:  # one for all words of a name
            out.append("SPDX:LicenseRef")
            known = False
    return out


def _space(m: re.Match) -> str:
    return "\f" if _BREAK.search(m[0]) else "\n" if "\n" in m[0] else " "


def _sentence(s: str) -> list[str]:
    """Identifiers of a normalised sentence, in order."""
    ids, at = [], 0

    def beside(part: str) -> list[str]:
        return ["UNKNOWN" for x in part.split("\f") if SPEAKS.search(x)]

    for m in _KNOWN.finditer(s):
        if m.start() >= at:
            line = max(s.rfind("\n", at, m.start()), s.rfind("\f", at, m.start()))
            ids += beside(s[at:line] if line >= 0 else "")
        if m.lastgroup == "SPDX":
            line = s[m.end() :].partition("\n")[0].replace("\f", " ")
            ids += expression(line)
        elif m.lastgroup.endswith(("Ref", "Later")) or m.lastgroup.startswith("CC"):
            ids.append("NOT" if _NOT.search(_LINE.sub(" ", s[max(0, m.start() - 60) : m.start()])) else m.lastgroup)
        else:
            ids.append(m.lastgroup)
        at = len(s) if m.lastgroup in _OPEN else next((i for i in range(m.end(), len(s)) if s[i] in "\n\f"), len(s))
    return ids + beside(s[at:])


def identify(text: str | None) -> tuple[list[str], list[str]]:
    """Identifiers of the sentences of a text, and the licences that its sequence of them means."""
    if not text or not TRIGGER.search(text):
        return [], []
    ids = []
    for s in _END.split(_SHOUT.sub("", _MARKS.sub(" ", _ABBREVIATED.sub(r"\1", _PLUS.sub(" or later", text))))):
        if TRIGGER.search(s):
            ids += _sentence(_JUNK.sub(_space, s.lower()).strip())
    return ids, licences(ids)


def licences(ids: list[str]) -> list[str]:
    """The licences of a sequence of identifiers, in the order of their first sentences."""
    if _FIRST.isdisjoint(ids):
        return []
    sequence, found = "".join(f"{i} " for i in ids), []
    for name, rule in _RULES:
        for m in list(rule.finditer(sequence))[::-1]:
            # A place that is taken keeps its length, so that places stay comparable.
            found.append((m.start(), name))
            sequence = sequence[: m.start()] + re.sub(r"\S", "-", m.group()) + sequence[m.end() :]
    return list(dict.fromkeys(n for _, n in sorted(found)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (in order of their first sentence), n_unknown."""

    slim(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            got = [identify(t) for t in b.column("text").to_pylist()]
            ids, found = ([g[i] for g in got] for i in (0, 1))
            cols = [b.column("doc_id"), *(pa.array(c, pa.list_(pa.string())) for c in (ids, found)), pa.array([i.count("UNKNOWN") for i in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sentence_ids", "licenses", "n_unknown"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, sentence_ids array<string>, licenses array<string>, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
