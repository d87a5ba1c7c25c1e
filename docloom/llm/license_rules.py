"""Signatures of licenses: hand-written patterns over words, and the forms that are built from them.

A pattern is written over lower-case words with one space between them. @ stands before its keyword, the word at which it
is looked for (/ between spellings), and + before another word that must be near. Groups don't capture.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases of the base and their labels.
BASE = {"gnu general public @license": "gpl", "apache @license": "apache", "@cc by": "cc-by", "mit @license": "mit"}

_V = "( version| v)? ?"
_L = "@license/licence"
#: label | name | words of the identifier in tags | words of the address
LICENSES = f"""
gpl | +gnu general public {_L} | gpl | gnu org licenses @gpl( html)?
gpl-1.0 | +gnu general public {_L}{_V}(1( 0)?|v1) | gpl 1 0 | gnu org licenses old licenses @gpl 1 0
gpl-2.0 | +gnu general public {_L}{_V}(2( 0)?|v2) | gpl 2 0 | gnu org licenses( old licenses)? @gpl 2 0
gpl-3.0 | +gnu general public {_L}{_V}(3( 0)?|v3) | gpl 3 0 | gnu org licenses @gpl 3 0
lgpl | +gnu (lesser|library) general public {_L} | lgpl | gnu org licenses @lgpl( html)?
lgpl-2.0 | +gnu (lesser|library) general public {_L}{_V}(2( 0)?|v2) | lgpl 2 0 | gnu org licenses( old licenses)? @lgpl 2 0
lgpl-2.1 | +gnu (lesser|library) general public {_L}{_V}(2 1|v2 1) | lgpl 2 1 | gnu org licenses( old licenses)? @lgpl 2 1
lgpl-3.0 | +gnu (lesser|library) general public {_L}{_V}(3( 0)?|v3) | lgpl 3 0 | gnu org licenses @lgpl 3 0
agpl | +affero general public {_L} | agpl | gnu org licenses @agpl( html)?
agpl-3.0 | +affero general public {_L}{_V}(3( 0)?|v3) | agpl 3 0 | gnu org licenses @agpl 3 0
gfdl | +gnu free documentation {_L} | gfdl | gnu org licenses @fdl( html)?
gfdl-1.3 | +gnu free documentation {_L}{_V}(1 3|v1 3) | gfdl 1 3 | gnu org licenses @fdl 1 3
apache | +apache( software)? {_L} | apache | apache org @licenses
apache-1.1 | +apache( software)? {_L}{_V}(1 1|v1 1) | apache 1 1 | apache org @licenses license 1 1
apache-2.0 | +apache( software)? {_L}{_V}(2( 0)?|v2( 0)?) | apache 2 0 | apache org @licenses license 2 0
mit | (the )?+mit( x11)? {_L} | mit | opensource org @licenses mit
mit-0 | +mit no attribution( {_L[1:].split('/')[0]})? @attribution | mit 0 | opensource org @licenses mit 0
x11 | +x11 {_L} | x11 | x org archive @licenses x11
isc | +isc {_L} | isc | opensource org @licenses isc
bsd | +bsd( style)? {_L} | bsd | opensource org @licenses bsd
bsd-2-clause | (2|two) clause( simplified)? @bsd( license)? | bsd 2 clause | opensource org @licenses bsd 2 clause
bsd-3-clause | (3|three) clause( new| modified)? @bsd( license)? | bsd 3 clause | opensource org @licenses bsd 3 clause
bsd-4-clause | (4|four) clause( original)? @bsd( license)? | bsd 4 clause | opensource org @licenses bsd 4 clause
0bsd | (0|zero) clause @bsd( license)? | 0bsd | opensource org @licenses 0bsd
mpl | @mozilla public licen[sc]e | mpl | mozilla org @mpl
mpl-1.1 | @mozilla public licen[sc]e{_V}(1 1|v1 1) | mpl 1 1 | mozilla org @mpl 1 1
mpl-2.0 | @mozilla public licen[sc]e{_V}(2( 0)?|v2( 0)?) | mpl 2 0 | mozilla org( en us)? @mpl 2 0
epl-1.0 | @eclipse public licen[sc]e( version| v)? ?(1( 0)?|v1( 0)?) | epl 1 0 | eclipse org legal @epl v10
epl-2.0 | @eclipse public licen[sc]e{_V}(2( 0)?|v2( 0)?) | epl 2 0 | eclipse org legal @epl( 2 0| v20)
eupl | @european union public licen[sc]e( version| v)? ?(1 [012]|v1 [012])? | eupl 1 [012] | joinup ec europa eu @eupl
cddl | +common development and @distribution licen[sc]e | cddl 1 0 | opensource org @licenses cddl 1 0
cpl-1.0 | @common public licen[sc]e | cpl 1 0 | opensource org @licenses cpl 1 0
artistic | @artistic licen[sc]e | artistic 1 0 | opensource org @licenses artistic license 1 0
artistic-2.0 | @artistic licen[sc]e{_V}(2( 0)?|v2) | artistic 2 0 | opensource org @licenses artistic license 2 0
bsl-1.0 | @boost software licen[sc]e | bsl 1 0 | boost org @license 1 0
busl-1.1 | business source {_L} | busl 1 1 | mariadb com @bsl11
zlib | (@zlib)( libpng)? licen[sc]e | zlib | zlib net @zlib license
unlicense | (the )?@unlicense | unlicense | @unlicense org
wtfpl | do what the fuck you want to public {_L} | wtfpl | @wtfpl net
psf-2.0 | @python software foundation licen[sc]e | psf 2 0 | docs python org @license
ruby | +ruby {_L} | ruby | ruby lang org @license
php-3.01 | +php {_L}( version 3 01)? | php 3 01 | php net @license 3 01
openssl | +openssl {_L} | openssl | openssl org source @license
ofl-1.1 | (sil )?+open font {_L} | ofl 1 1 | scripts sil org @ofl
ncsa | @ncsa( open source)? licen[sc]e | ncsa | opensource org @licenses ncsa
ms-pl | +microsoft public {_L} | ms pl | opensource org @licenses ms pl
ms-rl | +microsoft reciprocal {_L} | ms rl | opensource org @licenses ms rl
osl-3.0 | open software {_L}{_V}(3( 0)?|v3) | osl 3 0 | opensource org @licenses osl 3 0
afl-3.0 | @academic free licen[sc]e | afl 3 0 | opensource org @licenses afl 3 0
qpl-1.0 | q public {_L} | qpl 1 0 | opensource org @licenses qpl 1 0
odbl-1.0 | open (data commons open )?+database {_L} | odbl 1 0 | opendatacommons org licenses @odbl
odc-by-1.0 | open data commons @attribution licen[sc]e | odc by 1 0 | opendatacommons org @licenses by
pddl-1.0 | public domain dedication and {_L} | pddl 1 0 | opendatacommons org licenses @pddl
cc0 | (@cc0|creative commons zero) | cc0 1 0 | creativecommons org @publicdomain zero
cc-by | @cc by | cc by | creativecommons org @licenses by
cc-by-2.0 | @cc by 2 [05] | cc by 2 [05] | creativecommons org @licenses by 2 [05]
cc-by-3.0 | @cc by 3 0 | cc by 3 0 | creativecommons org @licenses by 3 0
cc-by-4.0 | @cc by 4 0 | cc by 4 0 | creativecommons org @licenses by 4 0
cc-by-sa | @cc by sa( [1234] [05])? | cc by sa [1234] [05] | creativecommons org @licenses by sa
cc-by-nd | @cc by nd( [1234] [05])? | cc by nd [1234] [05] | creativecommons org @licenses by nd
cc-by-nc | @cc by nc( [1234] [05])? | cc by nc [1234] [05] | creativecommons org @licenses by nc
cc-by-nc-sa | @cc by nc sa( [1234] [05])? | cc by nc sa [1234] [05] | creativecommons org @licenses by nc sa
cc-by-nc-nd | @cc by nc nd( [1234] [05])? | cc by nc nd [1234] [05] | creativecommons org @licenses by nc nd
"""

#: label | pattern: texts of licenses, notices and reservations of rights
NOTICES = """
mit | @permission is hereby granted free of charge to any person obtaining a copy
mit | the software is provided as is without @warranty of any kind
isc | @permission to use copy modify and or distribute this software for any purpose
bsd | @redistribution and use in source and binary forms with or without modification
bsd-3-clause | neither the name of .{1,60} nor the names of its contributors may be used to @endorse
gpl | this (program|library|file) is free software you can @redistribute it and or modify
gpl | either @version (2|3)( 0)? of the license or at your option any later version
lgpl | @lgpl( ?v?[23]( [01])?)?( or later)?
gpl | @gpl( ?v?[123]( 0)?)?( or later)?
gpl-2.0 | @gplv2
gpl-3.0 | @gplv3
agpl-3.0 | @agplv3
apache-2.0 | you may not use this file except in @compliance with the license
apache-2.0 | unless required by applicable law or agreed to in @writing software
mpl-2.0 | this source code form is subject to the terms of the @mozilla public license
unlicense | this is free and @unencumbered software released into the public domain
zlib | this software is provided as is without any express or implied @warranty in no event
cc-by | creative commons @attribution
cc-by-sa | creative commons @attribution share ?alike
cc-by-nd | creative commons @attribution no ?deriv(ative)?s
cc-by-nc | creative commons @attribution non ?commercial
cc-by-nc-sa | creative commons @attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons @attribution non ?commercial no ?deriv(ative)?s
public-domain | (released|placed|dedicated|is) (in|into|to) the public @domain
public-domain | no @copyright is claimed
proprietary | all rights @reserved
proprietary | @proprietary and confidential
proprietary | (may|must) not be @reproduced (or distributed )?without( prior| written)*( permission| consent)
copyright | @copyright ((c|by) )?(19|20)[0-9][0-9]
"""

_GRANT = "(licen[sc]ed|released|distributed|available|published|provided|covered|governed) (under|by) (the |a )?(terms (and conditions )?of )?(the |an? )?"
_LATER = "( only| or( any)?( later)?( version)?)?"


@dataclass(frozen=True)
class Rule:
    """A signature: keyword, pattern before it (each word with a space after), pattern after it (a space before)."""

    number: int
    keyword: str
    before: str
    after: str
    need: str
    label: str
    level: int  # 1 is the strongest; a detection goes if one of its own level or a stronger one contains it
    confidence: float
    base: bool = False


def _split(pattern: str) -> tuple[list[str], str, str, str]:
    """(keywords, before, after, word that must be near) of a pattern."""
    need = re.search(r"\+(\w+)", pattern)
    pattern = pattern.replace("+", "")
    if found := re.match(r"^\(@(\w+)(\|[^)]*)?\)(.*)$", pattern):  # a keyword alone in a group, or beside other spellings
        return [found[1]], "", found[3], need[1] if need else ""
    before, rest = pattern.split("@")
    words, after = re.match(r"([\w/]+)(.*)$", rest).groups()
    return words.split("/"), before, after, need[1] if need else ""


def rules() -> list[Rule]:
    """Every signature: base phrases, then each license's tag, grant, name and address, then notices."""
    out: list[Rule] = []

    def add(pattern: str, label: str, level: int, confidence: float, lead: str = "", tail: str = "", base: bool = False) -> None:
        keywords, before, after, need = _split(pattern)
        before, after = ((x.replace("(", "(?:")) for x in (lead + before, after + tail))
        first = len(out)
        out.extend(Rule(first + i, k, before, after, need, label, level, confidence, base) for i, k in enumerate(keywords))

    for pattern, label in BASE.items():
        add(pattern, label, 3, 0.6, base=True)
    for line in LICENSES.strip().splitlines():
        label, name, tag, address = (x.strip() for x in line.split(" | "))
        add(f"@spdx license identifier {tag}", label, 1, 1.0, tail=_LATER)
        add(name, label, 1, 0.95, lead=_GRANT, tail=_LATER)
        add(name, label, 2, 0.8)
        add(address, label, 2, 0.9)
    for line in NOTICES.strip().splitlines():
        label, pattern = (x.strip() for x in line.split(" | "))
        add(pattern, label, 3, 0.5)
    return out
