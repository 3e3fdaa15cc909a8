"""Signature rules for licence texts, written for normalised text: lower-case words, one space apart.

Each line: label | rank | pattern ; pattern ; ... A pattern is tried only where its keyword occurs: the
longest run of characters that each of its matches holds. Rank 4 is an identifier tag, 3 a name with its version, 2 a family or a clause of the licence's own
wording, 1 a general mention. A detection that lies within another one of a higher rank, or of the same
rank and longer, is suppressed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: What the labels' confidence is, by rank.
CONFIDENCE = {4: 1.0, 3: 0.95, 2: 0.8, 1: 0.4}

_RULES = r"""
apache-2.0 | 3 | apache license version 2( 0)? ; apache (software )?license v?2( 0)? ; apache 2 0 license ; apache org licenses license 2 0 ; apache2 license ; under the apache 2 0
apache-1.1 | 3 | apache (software )?license version 1 1 ; apache org licenses license 1 1 ; apache 1 1 license
apache-1.0 | 3 | apache (software )?license version 1 0 ; apache org licenses license 1 0
apache | 2 | apache (software )?license ; apache software foundation license
mit | 3 | (the )?mit license( mit)? ; released under (the )?mit ; licensed under (the )?mit( license)? ; mit licensed ; opensource org licenses mit ; expat license
mit | 2 | permission is hereby granted free of charge to any person obtaining a copy of this software ; without restriction including without limitation the rights to use copy modify merge publish distribute
mit-0 | 3 | mit no attribution( license)? ; mit 0 license
x11 | 3 | x11 license ; mit x11 license ; x consortium license
isc | 3 | isc license ; the isc licence ; opensource org licenses isc
isc | 2 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 3 | zero clause bsd( license)? ; bsd zero clause license ; 0bsd license ; free public license 1 0 0
bsd-2-clause | 3 | bsd 2 clause( license)? ; 2 clause bsd( license)? ; two clause bsd( license)? ; simplified bsd license ; freebsd license ; opensource org licenses bsd 2 clause
bsd-3-clause | 3 | bsd 3 clause( license)? ; 3 clause bsd( license)? ; three clause bsd( license)? ; new bsd license ; modified bsd license ; revised bsd license ; opensource org licenses bsd 3 clause
bsd-4-clause | 3 | bsd 4 clause( license)? ; 4 clause bsd( license)? ; original bsd license ; old bsd license
bsd | 2 | bsd (style )?licen[sc]ed? ; berkeley software distribution license
bsd | 2 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4-clause | 2 | all advertising materials mentioning features or use of this software must display
gpl-1.0 | 3 | gnu general public license( gpl)? (as published by the free software foundation )?(version|v) ?1( 0)? ; gnu general public license 1 0
gpl-2.0 | 3 | gnu general public license( gpl)? (as published by the free software foundation )?(either )?(version|v) ?2( 0)? ; gnu general public license 2 0 ; gnu org licenses old licenses gpl 2 0
gpl-2.0 | 3 | (gnu )?gpl ?(version|v)? ?2( 0)? ; gplv2 ; gpl2
gpl-3.0 | 3 | gnu general public license( gpl)? (as published by the free software foundation )?(either )?(version|v) ?3( 0)? ; gnu general public license 3 0 ; gnu org licenses gpl 3 0
gpl-3.0 | 3 | (gnu )?gpl ?(version|v)? ?3( 0)? ; gplv3 ; gpl3
gpl | 2 | gnu general public licen[sc]e ; the general public license as published by the free software foundation
gpl | 2 | gnu gpl ; gpl licensed? ; licensed under (the )?gpl ; released under (the )?gpl
gpl-or-later | 2 | (version|v) ?[123] (of the license )?or (at your option )?any later version ; gpl v?[23] or later
gpl-with-classpath | 3 | classpath exception ; gpl with the classpath exception
lgpl-2.0 | 3 | gnu library general public license( (version|v)? ?2( 0)?)? ; lgpl (version |v)?2 0
lgpl-2.1 | 3 | gnu lesser general public license( lgpl)? (as published by the free software foundation )?(either )?(version|v) ?2 1 ; lesser gpl (version|v)? ?2 1
lgpl-2.1 | 3 | (gnu )?lgpl ?(version|v)? ?2 1 ; lgplv2 1
lgpl-3.0 | 3 | gnu lesser general public license( lgpl)? (as published by the free software foundation )?(either )?(version|v) ?3( 0)? ; lesser gpl (version|v)? ?3
lgpl-3.0 | 3 | (gnu )?lgpl ?(version|v)? ?3( 0)? ; lgplv3
lgpl | 2 | (gnu )?lesser general public licen[sc]e ; lesser gpl
lgpl | 2 | gnu lgpl ; lgpl licensed? ; licensed under (the )?lgpl
agpl-3.0 | 3 | gnu affero general public license( agpl)? (version|v) ?3( 0)? ; gnu org licenses agpl 3 0
agpl-3.0 | 3 | (gnu )?agpl ?(version|v)? ?3( 0)? ; agplv3
agpl | 2 | (gnu )?affero general public licen[sc]e ; affero gpl
agpl | 2 | gnu agpl ; agpl licensed? ; licensed under (the )?agpl
gfdl-1.1 | 3 | gnu free documentation license (version|v) ?1 1
gfdl-1.2 | 3 | gnu free documentation license (version|v) ?1 2
gfdl-1.3 | 3 | gnu free documentation license (version|v) ?1 3 ; gnu org licenses fdl 1 3
gfdl | 2 | gnu free documentation licen[sc]e ; invariant sections with no front cover texts
cc-by-4.0 | 3 | creative commons attribution 4 0( international)?( public)?( license)?
cc-by-4.0 | 3 | cc by v? ?4( 0)? ; creativecommons org licenses by 4 0
cc-by-3.0 | 3 | creative commons attribution 3 0( unported)?( license)?
cc-by-3.0 | 3 | cc by v? ?3( 0)? ; creativecommons org licenses by 3 0
cc-by-2.5 | 3 | cc by v? ?2 5 ; creativecommons org licenses by 2 5 ; creative commons attribution 2 5
cc-by-2.0 | 3 | cc by v? ?2 0 ; creativecommons org licenses by 2 0
cc-by-1.0 | 3 | cc by v? ?1 0 ; creativecommons org licenses by 1 0
cc-by-sa-4.0 | 3 | cc by sa v? ?4( 0)? ; creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 3 | creative commons attribution share ?alike 4 0( international)?
cc-by-sa-3.0 | 3 | cc by sa v? ?3( 0)? ; creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 3 | creative commons attribution share alike 3 0( unported)?
cc-by-sa | 2 | cc by sa ; creative commons by sa
cc-by-sa | 2 | attribution share ?alike( license)?
cc-by-nc-4.0 | 3 | cc by nc v? ?4( 0)? ; creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 3 | creative commons attribution non ?commercial 4 0( international)?
cc-by-nc-3.0 | 3 | cc by nc v? ?3( 0)? ; creativecommons org licenses by nc 3 0
cc-by-nc | 2 | cc by nc ; creative commons by nc
cc-by-nc | 2 | attribution non ?commercial( license)?
cc-by-nd-4.0 | 3 | cc by nd v? ?4( 0)? ; creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | 3 | cc by nd v? ?3( 0)? ; creativecommons org licenses by nd 3 0
cc-by-nd | 2 | cc by nd ; creative commons by nd
cc-by-nd | 2 | attribution no ?deriv(ative)?s( license)?
cc-by-nc-sa-4.0 | 3 | cc by nc sa v? ?4( 0)? ; creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | cc by nc sa v? ?3( 0)? ; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa | 2 | cc by nc sa
cc-by-nc-sa | 2 | attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 | 3 | cc by nc nd v? ?4( 0)? ; creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | cc by nc nd v? ?3( 0)? ; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd | 2 | cc by nc nd
cc-by-nc-nd | 2 | attribution non ?commercial no ?deriv(ative)?s
cc-by | 2 | cc by ; creative commons by ; licensed under cc by
cc-by | 2 | creative commons attribution( license)?
cc0-1.0 | 3 | cc0 1 0( universal)? ; cc0 public domain dedication ; cc0 license
cc0-1.0 | 3 | creative commons zero( v?1 0)?( universal)? ; creativecommons org publicdomain zero 1 0
cc | 1 | creative commons licen[sc]ed? ; licensed under (a )?creative commons
unlicense | 3 | the unlicense ; unlicense org ; unlicensed? license
unlicense | 2 | this is free and unencumbered software released into the public domain
public-domain | 2 | released (in|into|to) the public domain ; dedicated to the public domain ; (is|are) (in )?(the )?public domain ; public domain dedication ; public domain mark
wtfpl | 3 | wtfpl( (version|v) ?2( 0)?)? ; wtfpl net
wtfpl | 3 | do what the fuck you want to public license
beerware | 3 | beer ?ware license ; you can buy me a beer in return ; the beer ware license revision 42
mpl-1.0 | 3 | mozilla public license( mpl)? (version|v)? ?1 0
mpl-1.1 | 3 | mozilla public license( mpl)? (version|v)? ?1 1 ; mozilla org mpl mpl 1 1
mpl-2.0 | 3 | mozilla public license( mpl)? (version|v)? ?2( 0)? ; mozilla org mpl 2 0
mpl-2.0 | 3 | mpl ?v?2( 0)?
mpl | 2 | mozilla public licen[sc]e
epl-1.0 | 3 | eclipse public license( epl)? (version|v)? ?1( 0)? ; eclipse org legal epl v10
epl-2.0 | 3 | eclipse public license( epl)? (version|v)? ?2( 0)? ; eclipse org legal epl 2 0
epl | 2 | eclipse public licen[sc]e
edl-1.0 | 3 | eclipse distribution license( (version|v)? ?1( 0)?)?
cddl-1.0 | 3 | cddl (version|v)? ?1 0
cddl-1.1 | 3 | cddl (version|v)? ?1 1
cddl | 2 | common development and distribution licen[sc]e( cddl)?( (version|v)? ?1 [01])?
cpl-1.0 | 3 | common public license( (version|v)? ?1 0)?
ipl-1.0 | 3 | ibm public license( (version|v)? ?1 0)?
eupl-1.1 | 3 | european union public licen[sc]e (version|v)? ?1 1 ; eupl v? ?1 1
eupl-1.2 | 3 | european union public licen[sc]e (version|v)? ?1 2 ; eupl v? ?1 2
eupl | 2 | european union public licen[sc]e
cecill-2.1 | 3 | cecill (version|v)? ?2 1
cecill-b | 3 | cecill b( license)?
cecill-c | 3 | cecill c( license)?
cecill | 2 | cecill( license| free software license)?
artistic-1.0 | 3 | artistic license (version|v)? ?1( 0)?
artistic-2.0 | 3 | artistic license (version|v)? ?2( 0)? ; perlfoundation org artistic license 2 0
artistic | 2 | (the |perl )?artistic licen[sc]e
perl-5 | 2 | under the same terms as perl( itself)?
python-2.0 | 3 | python software foundation license( version 2)? ; psf license( agreement)?( version 2)? ; python license 2 0
ruby | 3 | (the )?ruby license ; same terms as ruby
php-3.01 | 3 | php license (version|v)? ?3 01 ; php net license 3 01
php-3.0 | 3 | php license (version|v)? ?3 0
php | 2 | (the )?php licen[sc]e
zlib | 3 | zlib license ; zlib libpng license ; the zlib licence
zlib | 2 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 3 | libpng license( (version|v)? ?2)? ; png reference library license
bsl-1.0 | 3 | boost software license( (version|v)? ?1( 0)?)? ; boost org license 1 0
busl-1.1 | 3 | business source license( (version|v)? ?1 1)? ; bsl 1 1 change date
sspl-1.0 | 3 | server side public license( (version|v)? ?1)?
elastic-2.0 | 3 | elastic license( (version|v)? ?2( 0)?)? ; elastic co licensing elastic license
commons-clause | 3 | commons clause( license)?( condition)? ; commons clause restriction
polyform | 3 | polyform (noncommercial|shield|strict|small business|perimeter|internal use) license( 1 0 0)?
json | 2 | the software shall be used for good not evil
openssl | 3 | openssl license ; openssl toolkit license ; original ssleay license
ncsa | 3 | university of illinois ncsa open source license ; illinois open source license
ncsa | 3 | ncsa open source license
afl-3.0 | 3 | academic free license( (version|v)? ?3( 0)?)?
osl-3.0 | 3 | open software license( (version|v)? ?3( 0)?)?
qpl-1.0 | 3 | q public license( (version|v)? ?1( 0)?)?
sleepycat | 3 | sleepycat license ; sleepycat software product license
ofl-1.1 | 3 | sil open font license( (version|v)? ?1 1)? ; open font license 1 1 ; scripts sil org ofl
odbl-1.0 | 3 | open (data commons open )?database license( odbl)?( (version|v)? ?1 0)?
odbl-1.0 | 3 | odbl (version |v)?1 0 ; opendatacommons org licenses odbl
odc-by-1.0 | 3 | open data commons attribution license( (version|v)? ?1 0)? ; opendatacommons org licenses by
pddl-1.0 | 3 | open data commons public domain dedication and licen[sc]e( pddl)? ; opendatacommons org licenses pddl
cdla-permissive | 3 | community data license agreement permissive( (version|v)? ?[12] 0)?
cdla-sharing | 3 | community data license agreement sharing( (version|v)? ?1 0)?
ogl-uk-3.0 | 3 | open government licen[sc]e( for public sector information)?( (version|v)? ?3( 0)?)? ; nationalarchives gov uk doc open government licence
etalab-2.0 | 3 | licence ouverte etalab( 2 0)? ; etalab open licen[sc]e( 2 0)? ; licence etalab
dl-de-by-2.0 | 3 | datenlizenz deutschland namensnennung( version)?( 2 0)?
dl-de-zero-2.0 | 3 | datenlizenz deutschland zero( version)?( 2 0)?
llama | 3 | llama [234]( [0-9])? community license( agreement)? ; meta llama license
openrail | 3 | (creativeml |bigscience )?openrail( m| s| d)?( license)? ; bigcode openrail m v1
rail | 3 | responsible ai licen[sc]es? ; bigscience rail license v1 0
gemma | 3 | gemma terms of use ; gemma prohibited use policy
ms-pl | 3 | microsoft public licen[sc]e( ms pl)?
ms-rl | 3 | microsoft reciprocal licen[sc]e( ms rl)?
apsl-2.0 | 3 | apple public source license( (version|v)? ?2( 0)?)?
upl-1.0 | 3 | universal permissive license( (version|v)? ?1( 0)?)?
postgresql | 3 | postgresql licen[sc]e ; postgresql global development group license
curl | 3 | curl license ; curl se docs copyright
vim | 3 | vim license ; vim charityware
w3c | 3 | w3c software (and document )?(notice and )?license ; w3c document license
unicode | 3 | unicode license( agreement)?( v3)? ; unicode terms of use ; unicode data files and software license
ecl-2.0 | 3 | educational community license( (version|v)? ?2( 0)?)?
hpnd | 3 | historical permission notice and disclaimer
ntp | 3 | ntp license
naist | 3 | nara institute of science and technology license
blueoak-1.0.0 | 3 | blue oak model license( 1 0 0)? ; blueoakcouncil org license 1 0 0
parity | 3 | parity public license( [67] 0 0)?
mulan-psl-2.0 | 3 | mulan psl v? ?2 ; mulan permissive software license( (version|v)? ?2)?
proprietary | 2 | proprietary and confidential ; proprietary licen[sc]e ; this software is proprietary
all-rights-reserved | 2 | all rights reserved ; tous droits réservés ; alle rechte vorbehalten ; todos los derechos reservados
noncommercial | 2 | for non ?commercial use only ; non ?commercial research use ; not for commercial use ; academic use only
licence-mention | 1 | (is |are )?(licensed|released|distributed|available) under ; licensed under the terms of ; see the license (file )?for ; this (work|software|file|document|project) is licensed ; subject to the license
licence-mention | 1 | lizenziert unter ; steht unter der
licence-mention | 1 | sous licence ; sous la licence ; bajo (la )?licencia ; con licencia
copyright-notice | 1 | copyright c? ?(19|20)[0-9][0-9] ; copyright [a-z]+ (19|20)[0-9][0-9] ; copyright notice and this permission notice
"""

#: Identifier tags, spelled out of the identifier's own words.
_TAGGED = """MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 Unlicense Zlib BSL-1.0 0BSD Artistic-2.0 EUPL-1.2 OFL-1.1 ODbL-1.0 CDDL-1.0"""

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    number: int
    label: str
    rank: int
    keyword: str
    pattern: str


def keyword(pattern: str) -> str:
    """The longest run of plain characters outside groups, classes and what is optional; a pattern stands between spaces."""
    runs, run, depth, skip = [], "", 0, ""
    pattern = f" {pattern} "
    for i, ch in enumerate(pattern):
        if skip:
            skip = "" if ch == skip else skip
            continue
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch not in "()[{?.*+" and pattern[i + 1 : i + 2] not in ("?", "*", "{"):
            run += ch
            continue
        if depth == 0 or ch == "(":
            runs.append(run)
            run = ""
        skip = {"[": "]", "{": "}"}.get(ch, "")
    return max([*runs, run], key=len)


def rules() -> list[Rule]:
    out = []
    for line in _RULES.strip().splitlines():
        label, rank, patterns = (x.strip() for x in line.split(" | ", 2))
        out += [(label, int(rank), p.strip()) for p in patterns.split(" ; ")]
    for tag in _TAGGED.split():
        out.append((tag.lower(), 4, "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ")))
    return [Rule(i, label, rank, keyword(p), f"(?<= )(?:{p})(?= )") for i, (label, rank, p) in enumerate(out)]


#: Words too frequent in any text to sort texts by.
_EVERYDAY = set("the and use under org tion right rights ware later clause public software version any for general free open terms code source same copy permission beer is of to in a me you it its this as by or no not only one two three all used change with without model research return common business community exception foundation server unter".split())


def _cover(parts: dict[str, set[str]], weight) -> list[str]:
    """A few parts of which each keyword has one, chosen greedily."""
    left, out = set(parts), []
    while left:
        count: dict[str, int] = {}
        for k in left:
            for x in parts[k]:
                count[x] = count.get(x, 0) + 1
        out.append(max(count, key=lambda x: (count[x] * weight(x), len(x), x)))
        left = {k for k in left if out[-1] not in parts[k]}
    return sorted(out)


def gates(keywords: list[str]) -> tuple[list[str], list[str]]:
    """(words, strings): each keyword holds one of the words as a whole word, or else contains one of the strings; a text
    without any of them can be left alone."""

    def pieces(k: str) -> set[str]:
        w = [m.span() for m in re.finditer(r"\S+", k)]
        runs = {k[a:b] for i, (a, _) in enumerate(w) for _, b in w[i : i + 3]}
        stems = {k[a : min(b, a + 5)] for a, b in w if b - a >= 5}
        return {k} | {x for x in runs | stems if not set(x.split()) <= _EVERYDAY and len(x) >= 4}

    whole = {k: {w for w in re.findall(r"(?<= )\S+(?= )", k) if w not in _EVERYDAY and (len(w) > 2 or w == "cc")} for k in set(keywords)}
    words = _cover({k: w for k, w in whole.items() if w}, lambda x: 1)
    return words, _cover({k: {x for x in pieces(k) if x in k} for k, w in whole.items() if not w}, lambda x: 1 if len(x) >= 5 else 0.5)
