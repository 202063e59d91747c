"""License signatures as templates over words, and their regular expressions.

A template is a list of words: ``word``, ``(a|b)`` for either word, and a trailing ``?`` for an optional one. Texts
are matched in wrapped form (every word between two spaces of its own), so a pattern can only match whole words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: label | gate word (a word that every match has) | template of the name
NAMES = """
mit | mit | mit (license|licence)
mit | mit | mit x11 (license|licence)
mit | expat | expat (license|licence)
mit-0 | mit | mit no attribution (license|licence)?
apache-1.1 | apache | apache software? (license|licence) version? 1 1
apache-2.0 | apache | apache software? (license|licence) version? 2 0?
apache-2.0 | apache | apache (license|licence) v2 0?
apache | apache | apache software? (license|licence)
gpl-2.0 | general | gnu? general public (license|licence) version? 2 0?
gpl-2.0 | general | gnu? general public (license|licence) v2
gpl-3.0 | general | gnu? general public (license|licence) version? 3 0?
gpl-3.0 | general | gnu? general public (license|licence) v3
gpl-2.0 | gpl | gnu? gpl version? 2 0? only?
gpl-2.0 | gplv2 | gnu? gplv2
gpl-3.0 | gpl | gnu? gpl version? 3 0? only?
gpl-3.0 | gplv3 | gnu? gplv3
gpl | general | gnu? general public (license|licence)
lgpl-2.0 | general | gnu? library general public (license|licence) version? 2 0?
lgpl-2.1 | general | gnu? lesser general public (license|licence) version? 2 1
lgpl-3.0 | general | gnu? lesser general public (license|licence) version? 3 0?
lgpl | general | gnu? (lesser|library) general public (license|licence)
lgpl-2.1 | lgpl | gnu? lgpl version? 2 1
lgpl-3.0 | lgpl | gnu? lgpl version? 3 0?
lgpl | lgpl | gnu? lgpl
agpl-3.0 | affero | gnu? affero general public (license|licence) version? 3 0?
agpl | affero | gnu? affero general public (license|licence)
agpl-3.0 | agpl | gnu? agpl version? 3 0?
gfdl-1.3 | documentation | gnu? free documentation (license|licence) version? 1 3
gfdl | documentation | gnu? free documentation (license|licence)
bsd-2-clause | bsd | bsd 2 clause (license|licence)?
bsd-2-clause | bsd | (simplified|freebsd) bsd (license|licence)
bsd-3-clause | bsd | bsd 3 clause (license|licence)?
bsd-3-clause | bsd | (new|revised|modified) bsd (license|licence)
bsd-4-clause | bsd | bsd 4 clause (license|licence)?
bsd | bsd | bsd (style|type)? (license|licence)
isc | isc | isc (license|licence)
zlib | zlib | zlib libpng? (license|licence)
mpl-1.1 | mozilla | mozilla public (license|licence) version? 1 1
mpl-2.0 | mozilla | mozilla public (license|licence) version? 2 0?
mpl | mozilla | mozilla public (license|licence)
epl-1.0 | eclipse | eclipse public (license|licence) version? 1 0
epl-2.0 | eclipse | eclipse public (license|licence) version? 2 0?
epl | eclipse | eclipse public (license|licence)
cddl-1.0 | cddl | cddl version? 1 0
cddl | development | common development and distribution (license|licence)
eupl-1.2 | european | european union public (license|licence) version? 1 2
eupl | european | european union public (license|licence)
artistic-2.0 | artistic | artistic (license|licence) version? 2 0?
artistic | artistic | artistic (license|licence)
boost-1.0 | boost | boost software (license|licence) version? 1? 0?
unlicense | unlicense | the unlicense
wtfpl | public | do what the fuck you want to public (license|licence)
ofl-1.1 | sil | sil open font (license|licence) version? 1? 1?
cc0-1.0 | cc0 | cc0 1 0 universal?
cc0-1.0 | cc0 | cc0
cc-by-nc-nd | nc | cc by nc nd 4? 0?
cc-by-nc-sa | nc | cc by nc sa 4? 0?
cc-by-nc | nc | cc by nc 4? 0?
cc-by-nd | nd | cc by nd 4? 0?
cc-by-sa-4.0 | sa | cc by sa 4 0
cc-by-sa-3.0 | sa | cc by sa 3 0
cc-by-sa | sa | cc by sa
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by | cc | cc by
cc-by-nc-nd | commons | creative commons attribution (noncommercial|non) commercial? no (derivatives|derivs)
cc-by-nc-sa | commons | creative commons attribution (noncommercial|non) commercial? share alike
cc-by-nc | commons | creative commons attribution (noncommercial|non) commercial?
cc-by-nd | commons | creative commons attribution no (derivatives|derivs)
cc-by-sa | commons | creative commons attribution (share|sharealike) alike?
cc-by-4.0 | commons | creative commons attribution 4 0 international?
cc-by | commons | creative commons attribution (license|licence)?
creative-commons | commons | creative commons (license|licence)
odbl-1.0 | database | open database (license|licence)
pddl-1.0 | dedication | public domain dedication and (license|licence)
python-2.0 | python | python software foundation (license|licence)
postgresql | postgresql | postgresql (license|licence)
ms-pl | microsoft | microsoft public (license|licence)
ms-rl | microsoft | microsoft reciprocal (license|licence)
openssl | openssl | openssl (license|licence)
php-3.01 | php | php (license|licence) version? 3? 0?
ruby | ruby | ruby (license|licence)
qpl-1.0 | public | q public (license|licence)
w3c | w3c | w3c software? notice? and? (license|licence)
afl-3.0 | academic | academic free (license|licence) version? 3? 0?
osl-3.0 | open | open software (license|licence) version? 3? 0?
ncsa | illinois | university of illinois ncsa? open source (license|licence)
bsl-1.1 | business | business source (license|licence) version? 1? 1?
sspl-1.0 | server | server side public (license|licence)
elastic-2.0 | elastic | elastic (license|licence) version? 2? 0?
vsl-1.0 | vovida | vovida software (license|licence)
naist | naist | naist (license|licence)
"""

#: label | gate word | priority | template: notices that are not the name of a license
NOTICES = """
reserved | reserved | 2 | all rights reserved
reserved | reserved | 2 | no rights are? granted all? rights? reserved
reserved | rechte | 2 | alle rechte vorbehalten
reserved | droits | 2 | tous droits réservés
reserved | derechos | 2 | todos los derechos reservados
public-domain | domain | 2 | (dedicated|released|placed) (to|into|in) the public domain
public-domain | domain | 3 | is in the public domain
public-domain | domain | 4 | public domain
proprietary | proprietary | 2 | proprietary and confidential
proprietary | confidential | 3 | confidential and proprietary
proprietary | unauthorized | 2 | unauthorized (copying|reproduction|distribution) of this (file|work|document)
copyright-notice | copyright | 4 | copyright c? (19|20)?
bsd | redistribution | 1 | redistribution and use in source and binary forms with or without modification
mit | hereby | 1 | permission is hereby granted free of charge to any person obtaining a copy
isc | permission | 1 | permission to use copy modify and or? distribute this software for any purpose
apache-2.0 | compliance | 2 | you may not use this file except in compliance with the (license|licence)
gpl | redistribute | 2 | you can redistribute it and or modify it under the terms of the gnu general public (license|licence)
zlib | altered | 2 | altered source versions must be plainly marked as such
mpl-2.0 | mpl | 2 | if a copy of the mpl was not distributed with this file
boost-1.0 | boost | 2 | distributed under the boost software (license|licence)
warranty | warranty | 4 | without warranty of any kind
attribution | attribution | 4 | attribution required
noncommercial | commercial | 3 | for? non commercial use only
noncommercial | noncommercial | 3 | for? noncommercial use only
mit | substantial | 1 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement | 3 | fitness for a particular purpose and noninfringement
mit | sublicense | 2 | to use copy modify merge publish distribute sublicense and or sell copies
bsd | endorse | 1 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd | reproduce | 2 | redistributions in binary form must reproduce the above copyright notice
bsd | retain | 2 | redistributions of source code must retain the above copyright notice
bsd-4-clause | acknowledgement | 1 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | consequential | 3 | direct indirect incidental special exemplary or consequential damages
apache-2.0 | unless | 2 | unless required by applicable law or agreed to in writing software distributed under the (license|licence)
apache-2.0 | conditions | 3 | on an as is basis without warranties or conditions of any kind
apache-2.0 | contributor | 2 | each contributor hereby grants to you a perpetual worldwide
apache-2.0 | derivative | 3 | you may reproduce and distribute copies of the work or derivative works
gpl | hope | 2 | distributed in the hope that it will be useful but without any warranty
gpl | merchantability | 3 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | foundation | 3 | free software foundation inc (51|59|675) (franklin|temple|mass)
gpl | received | 2 | you should have received a copy of the gnu general public (license|licence)
gpl | program | 3 | this program is free software
gpl | copyleft | 4 | copyleft
gpl-2.0 | torvalds | 3 | as published by linus torvalds
gpl-2.0 | option | 2 | either version 2 of the (license|licence) or at your option any later version
gpl-3.0 | option | 2 | either version 3 of the (license|licence) or at your option any later version
gpl-3.0 | installation | 3 | installation information for a user product
lgpl | lesser | 2 | terms of the gnu lesser general public (license|licence)
lgpl | library | 2 | terms of the gnu library general public (license|licence)
lgpl | relink | 3 | modify the library and then relink
agpl-3.0 | affero | 2 | terms of the gnu affero general public (license|licence)
agpl-3.0 | interacting | 3 | users interacting with it remotely through a computer network
gfdl | invariant | 2 | with no invariant sections no front cover texts and no back cover texts
gfdl | invariant | 3 | with the invariant sections being
mpl | mozilla | 2 | subject to the terms of the mozilla public (license|licence)
mpl-2.0 | incompatible | 2 | incompatible with secondary licenses
mpl-1.1 | initial | 3 | the initial developer of the original code is
epl | accompanying | 2 | this program and the accompanying materials are made available under the terms of the eclipse
cddl | common | 2 | terms of the common development and distribution (license|licence)
isc | isc | 3 | isc style (license|licence)
isc | fee | 2 | for any purpose with or without fee is hereby granted
isc | tortious | 3 | an action of contract negligence or other tortious action
zlib | misrepresented | 1 | the origin of this software must not be misrepresented
zlib | misrepresented | 2 | must not be misrepresented as being the original software
zlib | liable | 3 | in no event will the authors be held liable for any damages
boost-1.0 | machine | 2 | machine executable object code generated by a source language processor
unlicense | unencumbered | 1 | this is free and unencumbered software released into the public domain
unlicense | anyone | 2 | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | jurisdictions | 3 | in jurisdictions that recognize copyright laws
wtfpl | fuck | 1 | do what the fuck you want to
beerware | beer | 1 | you can buy me a beer in return
beerware | beerware | 3 | beerware (license|licence)
cc0-1.0 | waived | 1 | waived all copyright and related or neighboring rights
cc0-1.0 | affirmer | 2 | affirmer hereby overtly fully permanently
cc-by | credit | 2 | you must give appropriate credit provide a link to the (license|licence)
cc-by | creativecommons | 2 | creativecommons org licenses by
cc-by-sa | creativecommons | 1 | creativecommons org licenses by sa
cc-by-nc | creativecommons | 1 | creativecommons org licenses by nc
cc-by-nd | creativecommons | 1 | creativecommons org licenses by nd
cc0-1.0 | creativecommons | 1 | creativecommons org publicdomain zero
public-domain | creativecommons | 1 | creativecommons org publicdomain mark
cc-by-sa | remix | 3 | if you remix transform or build upon the material you must distribute your contributions under the same
cc-by-nd | derivatives | 3 | no derivatives
cc-by-sa | alike | 3 | share alike
ofl-1.1 | font | 2 | reserved font name
ofl-1.1 | bundled | 3 | may be bundled redistributed and or sold with any software
odbl-1.0 | odbl | 3 | open data commons odbl
odbl-1.0 | commons | 2 | open data commons open database (license|licence)
odc-by | commons | 2 | open data commons attribution (license|licence)
pddl-1.0 | dedication | 2 | open data commons public domain dedication
cdla | cdla | 3 | cdla (permissive|sharing)
ogl-uk | ogl | 2 | open government (license|licence) v? (1|2|3) ogl
ogl-uk | sector | 2 | contains public sector information licensed under the open government (license|licence)
psf-2.0 | psf | 2 | psf is making python available to licensee
openssl | openssl | 1 | this product includes software developed by the openssl project
apache-1.1 | foundation | 2 | this product includes software developed by the apache software foundation
perl | perl | 2 | same terms as perl itself
ruby | ruby | 3 | same terms as ruby
jquery | sizzle | 4 | sizzle js
busl-1.1 | change | 2 | change date change (license|licence)
sspl-1.0 | offering | 3 | offering the program as a service
elastic-2.0 | hosted | 2 | to third parties as a hosted or managed service
commons-clause | clause | 1 | commons clause (license|licence) condition
polyform | polyform | 2 | polyform (noncommercial|shield|strict|small) (license|licence)?
llama | llama | 2 | llama (2|3) community (license|licence)
openrail | openrail | 2 | (creativeml|bigscience) openrail
openrail | responsible | 3 | responsible ai (license|licence)
json | evil | 1 | the software shall be used for good not evil
noncommercial | noncommercial | 3 | noncommercial purposes only
noncommercial | personal | 3 | for personal and non commercial use
noncommercial | academic | 3 | for academic use only
noncommercial | research | 3 | for research purposes only
proprietary | confidential | 2 | confidential and proprietary information of
proprietary | proprietary | 3 | proprietary (license|licence)
proprietary | trade | 3 | contains trade secrets
proprietary | internal | 3 | for internal use only
proprietary | redistribution | 3 | not for redistribution
proprietary | disclose | 2 | you shall not disclose such confidential information
proprietary | reverse | 2 | reverse engineer decompile or disassemble
proprietary | agreement | 3 | end user (license|licence) agreement
proprietary | evaluation | 3 | evaluation (license|licence) agreement
proprietary | subscription | 4 | subscription agreement
reserved | retrieval | 2 | stored in a retrieval system or transmitted in any form
reserved | reproduced | 2 | no part of this (publication|book|work|document) may be reproduced
reserved | reproduced | 3 | may not be reproduced without (the|prior) written? permission
reserved | copied | 3 | may not be copied or distributed
reserved | reserves | 4 | reserves all rights
reserved | nachdruck | 2 | nachdruck verboten
reserved | vervielfältigung | 3 | jede vervielfältigung bedarf der zustimmung
reserved | interdite | 2 | (toute|reproduction) reproduction? interdite
reserved | prohibida | 2 | prohibida la reproducción total o parcial
reserved | reservados | 2 | reservados todos los derechos
reserved | reservados | 2 | todos os direitos reservados
reserved | riservati | 2 | tutti i diritti riservati
copyright-notice | copr | 4 | copr (19|20)?
copyright-notice | copyrighted | 4 | copyrighted (material|work)
copyright-notice | urheberrechtlich | 3 | urheberrechtlich geschützt
trademark | trademark | 4 | is a registered trademark of
trademark | respective | 4 | all other trademarks are the property of their respective owners
patent | patent | 4 | patent pending
attribution | attribution | 3 | with attribution to the original author
"""

#: priority | template: how a text grants a license; NAME stands for the name's template
FORMS = """
1 | (licensed|released|distributed|available|published|provided|shared) under the? terms? of? the? NAME
2 | subject to the? terms? of? the? NAME
3 | NAME
"""

#: label | short identifiers with a version or clause, which name a license by themselves; gate: the first word
VERSIONED = """
apache-1.0 | apache 1 0
apache-1.1 | apache 1 1
apache-2.0 | apache 2 0
apache-2.0 | apache v2 0?
mpl-1.1 | mpl 1 1
mpl-2.0 | mpl 2 0
epl-1.0 | epl 1 0
epl-2.0 | epl 2 0
gpl-1.0 | gpl 1 0
gpl-2.0 | gpl 2 0
gpl-2.0 | gpl v2
gpl-3.0 | gpl 3 0
gpl-3.0 | gpl v3
lgpl-2.0 | lgpl 2 0
lgpl-2.1 | lgpl 2 1
lgpl-2.1 | lgpl v2 1
lgpl-2.1 | lgplv2 1
lgpl-3.0 | lgpl 3 0
lgpl-3.0 | lgpl v3
lgpl-3.0 | lgplv3
agpl-3.0 | agpl 3 0
agpl-3.0 | agpl v3
agpl-3.0 | agplv3
gfdl-1.1 | gfdl 1 1
gfdl-1.2 | gfdl 1 2
gfdl-1.3 | gfdl 1 3
bsd-1-clause | bsd 1 clause
cddl-1.0 | cddl 1 0
cddl-1.1 | cddl 1 1
eupl-1.1 | eupl 1 1
eupl-1.2 | eupl 1 2
boost-1.0 | bsl 1 0
bsl-1.1 | busl 1 1
ofl-1.1 | ofl 1 1
afl-3.0 | afl 3 0
osl-3.0 | osl 3 0
qpl-1.0 | qpl 1 0
vsl-1.0 | vsl 1 0
sspl-1.0 | sspl 1 0
odbl-1.0 | odbl 1 0
pddl-1.0 | pddl 1 0
upl-1.0 | upl 1 0
ecl-2.0 | ecl 2 0
psf-2.0 | psf 2 0
blueoak-1.0.0 | blueoak 1 0 0
"""

#: label | short identifiers that are ordinary words too and only name a license in an SPDX line or a grant
SHORT = """
mit | mit
mit | x11
mit-0 | mit 0
apache | apache
isc | isc
zlib | zlib
0bsd | 0bsd
bsd | bsd
bsd-2-clause | bsd 2 clause
bsd-3-clause | bsd 3 clause
bsd-4-clause | bsd 4 clause
gpl | gpl
lgpl | lgpl
agpl | agpl
gfdl | gfdl
mpl | mpl
epl | epl
cddl | cddl
eupl | eupl
unlicense | unlicense
wtfpl | wtfpl
cc0-1.0 | cc0
cc-by | cc by
cc-by-3.0 | cc by 3 0
cc-by-4.0 | cc by 4 0
cc-by-sa | cc by sa
cc-by-sa-3.0 | cc by sa 3 0
cc-by-sa-4.0 | cc by sa 4 0
cc-by-nd | cc by nd
cc-by-nc | cc by nc
cc-by-nc-sa | cc by nc sa
cc-by-nc-nd | cc by nc nd
ms-pl | ms pl
ms-rl | ms rl
ncsa | ncsa
openssl | openssl
postgresql | postgresql
"""

#: label | identifiers for SPDX lines alone
SPDX = """
artistic-1.0 | artistic 1 0
artistic-2.0 | artistic 2 0
elastic-2.0 | elastic 2 0
python-2.0 | python 2 0
php-3.01 | php 3 01
php-3.0 | php 3 0
ruby | ruby
w3c | w3c
naist | naist 2003
curl | curl
vim | vim
hpnd | hpnd
ntp | ntp
ijg | ijg
freetype | ftl
unicode | unicode dfs 2016
unicode | unicode 3 0
libpng-2.0 | libpng 2 0
"""

#: The second license of an expression such as "Apache-2.0 OR MIT", where it is an ordinary word.
OPERANDS = "(mit|isc|zlib|unlicense|0bsd|0|1|clause|only|later) (or|and)"
GRANT = FORMS.strip().splitlines()[0].split(" | ")[1]
#: tables | priority | template | gate: how short identifiers stand in texts; empty: the first word of the identifier
SHORT_FORMS = (
    ((VERSIONED, SHORT, SPDX), 1, "spdx (license|licence) identifier NAME", "spdx"),
    ((VERSIONED, SHORT), 1, GRANT, ""),
    ((VERSIONED, SHORT), 2, "NAME licensed", "licensed"),
    ((VERSIONED,), 3, "NAME", ""),
)

CONFIDENCE = {1: 0.95, 2: 0.9, 3: 0.75, 4: 0.4}


class Rule(NamedTuple):
    gate: str
    pattern: str
    priority: int
    label: str
    confidence: float
    needle: str  # stands in every match


def rule(gate: str, template: str, priority: int, label: str) -> Rule:
    return Rule(gate, compile_template(template), priority, label, CONFIDENCE[priority], longest_fixed(template))


def longest_fixed(template: str) -> str:
    """The longest run of words of a template that are neither optional nor alternatives, as it stands in a wrapped text."""
    runs = " ".join("|" if t[0] == "(" or t[-1] == "?" else t for t in template.split()).split("|")
    return max(("".join(f" {w} " for w in r.split()) for r in runs), key=len)


def compile_template(template: str) -> str:
    out = []
    for token in template.split():
        optional = token.endswith("?")
        word = token.rstrip("?")
        body = f" (?:{word[1:-1]}) " if word[0] == "(" else f" {word} "
        out.append(f"(?:{body})?" if optional else body)
    return "".join(out)


def rules() -> list[Rule]:
    """All rules, in order."""
    split = lambda text: [[x.strip() for x in re.split(r" \| ", line, maxsplit=3)] for line in text.strip().splitlines()]
    out = [rule(gate, template, int(p), label) for label, gate, p, template in split(NOTICES)]
    for p, form in split(FORMS):
        out += [rule(gate, form.replace("NAME", name), int(p), label) for label, gate, name in (x[:2] + [" | ".join(x[2:])] for x in split(NAMES))]
    for tables, p, form, gate in SHORT_FORMS:
        out += [rule(gate or name.split()[0], form.replace("NAME", name), p, label) for text in tables for label, name in split(text)]
    out += [rule(name, f"{OPERANDS} {name}", 4, name) for name in ("mit", "isc", "zlib", "unlicense", "0bsd")]
    return list(dict.fromkeys(out))
