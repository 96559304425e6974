"""Ordered signature rules for license texts, written by hand.

A rule is a line ``kind keyword regex`` below its label. The regexes read text
as lower-case words parted by single spaces (punctuation and line ends are
gone: ``GPL-2.0`` reads ``gpl 2 0``) and match whole words. ``keyword`` is a
word that every match holds, or several parted by ``+``; the rule runs only on texts with
all of them, and the first, the rarest, decides whether a text is looked at.

Kinds, by falling priority: ``tag`` a machine-readable identifier, ``grant`` a sentence that
puts the work under the license, ``text`` words of the license's own body,
``url`` its address, ``exact`` name with version, ``name`` the bare name, ``hint`` weak evidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: kind -> (priority, confidence)
KINDS = {"tag": (7, 1.0), "grant": (6, 0.98), "text": (5, 0.95), "url": (4, 0.9), "exact": (3, 0.85), "name": (2, 0.7), "hint": (1, 0.3)}

#: Short forms inside the regexes: a granting verb, an optional version word, an identifier tag.
SHORT = {
    "{G}": r"(?:(?:re)?licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed|redistributed|shared|used)"
           r"(?: \S+){0,3}? (?:under|by|with|to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?",
    "{V}": r"(?: licen[cs]e)?(?: agreement)?(?: version| ver| v)?",
    "{T}": r"(?:spdx licen[cs]e identifier|licen[cs]e identifier|package licen[cs]e declared|package licen[cs]e concluded)",
    "{CC}": r"(?:creative commons|cc)",
    "{I}": r"(?: international| unported| generic| intergovernmental)?",
}

#: Phrases of the fixed base set, never suppressed: label -> words.
BASE = [("gpl", "license", "gnu general public license"), ("apache", "license", "apache license"), ("cc-by", "cc", "cc by"), ("mit", "license", "mit license")]

RULES_TEXT = r"""
gpl-3.0
  tag identifier {T} gpl 3 0(?: only| or later)?
  tag gplv3 {T} gplv3
  grant gnu {G} gnu general public license{V} 3(?: 0)?
  grant gpl {G} (?:gnu )?gpl{V} 3(?: 0)?
  grant gplv3 {G} (?:gnu )?gplv3
  grant redistribute you can redistribute it and or modify it under the terms of the gnu general public license(?: \S+){0,10}? version 3
  text june gnu general public license version 3 29 june 2007
  text propagate to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
  url gnu gnu org (?:licenses|licences) gpl 3 0
  exact gnu gnu general public license{V} 3(?: 0)?
  exact gpl (?:gnu )?gpl{V} 3(?: 0)?
  exact gplv3 (?:gnu )?gplv3
gpl-2.0
  tag identifier {T} gpl 2 0(?: only| or later)?
  grant gnu {G} gnu general public license{V} 2(?: 0)?
  grant gpl {G} (?:gnu )?gpl{V} 2(?: 0)?
  grant gplv2 {G} (?:gnu )?gplv2
  grant redistribute you can redistribute it and or modify it under the terms of the gnu general public license(?: \S+){0,10}? version 2
  text june gnu general public license version 2 june 1991
  text franklin free software foundation inc 5[19] franklin st(?:reet)?
  url gnu gnu org (?:licenses|licences)(?: old licenses)? gpl 2 0
  exact gnu gnu general public license{V} 2(?: 0)?
  exact gpl (?:gnu )?gpl{V} 2(?: 0)?
  exact gplv2 (?:gnu )?gplv2
gpl-1.0
  tag identifier {T} gpl 1 0(?: only| or later)?
  exact gnu gnu general public license{V} 1(?: 0)?
  exact gplv1 (?:gnu )?gplv1
gpl
  name gpl (?:gnu )?gpl
  name license gnu (?:general )?public license
  text warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
  text copy you should have received a copy of the gnu general public license
  url gnu gnu org licenses gpl html
  url copyleft gnu org copyleft gpl html
lgpl-3.0
  tag identifier {T} lgpl 3 0(?: only| or later)?
  grant lesser {G} gnu lesser general public license{V} 3(?: 0)?
  grant lgplv3 {G} (?:gnu )?lgplv3
  url lgpl gnu org licenses lgpl 3 0
  exact lesser gnu lesser general public license{V} 3(?: 0)?
  exact lgplv3 (?:gnu )?lgplv3
  exact lgpl (?:gnu )?lgpl{V} 3(?: 0)?
lgpl-2.1
  tag identifier {T} lgpl 2 1(?: only| or later)?
  grant lesser {G} gnu lesser general public license{V} 2 1
  text february gnu lesser general public license version 2 1 february 1999
  url lgpl gnu org licenses(?: old licenses)? lgpl 2 1
  exact lesser gnu lesser general public license{V} 2 1
  exact lgpl (?:gnu )?lgpl{V} 2 1
  exact lgplv2 (?:gnu )?lgplv2(?: 1)?
lgpl-2.0
  tag identifier {T} lgpl 2 0(?: only| or later)?
  exact library gnu library general public license{V} 2(?: 0)?
lgpl
  name lesser gnu lesser general public license
  name library gnu library general public license
  name lgpl (?:gnu )?lgpl
  text copy you should have received a copy of the gnu lesser general public license
agpl-3.0
  tag identifier {T} agpl 3 0(?: only| or later)?
  grant affero {G} gnu affero general public license{V} 3(?: 0)?
  text november gnu affero general public license version 3 19 november 2007
  url agpl gnu org licenses agpl 3 0
  exact affero gnu affero general public license{V} 3(?: 0)?
  exact agplv3 (?:gnu )?agplv3
agpl
  name affero (?:gnu )?affero general public license
  name agpl (?:gnu )?agpl
gfdl
  tag identifier {T} gfdl 1 [123](?: only| or later)?
  grant documentation {G} gnu free documentation license
  name documentation gnu free documentation license
  name gfdl gfdl
  url fdl gnu org (?:licenses|copyleft) fdl
apache-2.0
  tag identifier {T} apache 2 0
  grant apache {G} apache(?: software)? licen[cs]e{V} 2(?: 0)?
  grant compliance you may not use this file except in compliance with the license
  text january apache license version 2 0 january 2004
  text applicable unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
  url apache apache org licenses license 2 0
  exact apache apache(?: software)? licen[cs]e{V} 2(?: 0)?
  exact apache apache 2(?: 0)? licen[cs]e
  exact asl asl 2 0
apache-1.1
  tag identifier {T} apache 1 1
  exact apache apache(?: software)? licen[cs]e{V} 1 1
  text foundation this product includes software developed by the apache software foundation
  url apache apache org licenses license 1 1
apache-1.0
  tag identifier {T} apache 1 0
  exact apache apache(?: software)? licen[cs]e{V} 1 0
apache
  name apache apache(?: software)? licen[cs]e
  grant apache {G} apache(?: software)? licen[cs]e
mit
  tag identifier {T} mit
  tag osi license osi approved mit license
  grant mit {G} mit(?: x11)? licen[cs]e
  grant mit+under (?:licen[cs]ed|released|distributed|available|published|provided) under(?: the)? mit
  text deal permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the software )?to deal in the software without restriction
  text sublicense rights to use copy modify merge publish distribute sublicense and or sell copies of the software
  text noninfringement the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
  url mit opensource org licen[cs]es mit(?: license)?
  name mit mit licen[cs]e
  name expat expat licen[cs]e
mit-0
  tag identifier {T} mit 0
  name attribution mit no attribution(?: license)?
x11
  tag identifier {T} x11
  name x11 (?:mit )?x11 licen[cs]e
isc
  tag identifier {T} isc
  grant isc {G} isc licen[cs]e
  text isc internet systems consortium(?: inc)? isc
  text hereby permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
  name isc isc licen[cs]e
bsd-2-clause
  tag identifier {T} bsd 2 clause
  grant bsd {G} (?:simplified bsd|2 clause bsd|bsd 2 clause) licen[cs]e
  url bsd opensource org licenses bsd 2 clause
  exact simplified simplified bsd licen[cs]e
  exact freebsd freebsd licen[cs]e
  exact bsd (?:2|two) clause bsd(?: licen[cs]e)?
  exact bsd bsd 2 clause
bsd-3-clause
  tag identifier {T} bsd 3 clause
  grant bsd {G} (?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause) licen[cs]e
  text endorse neither the name(?: of)?(?: \S+){1,8}? nor the names of its contributors may be used to endorse or promote products
  url bsd opensource org licenses bsd 3 clause
  exact bsd (?:new|modified|revised) bsd licen[cs]e
  exact bsd (?:3|three) clause bsd(?: licen[cs]e)?
  exact bsd bsd 3 clause
bsd-4-clause
  tag identifier {T} bsd 4 clause
  text advertising all advertising materials mentioning features or use of this software must display
  exact bsd (?:original bsd licen[cs]e|(?:4|four) clause bsd|bsd 4 clause)
bsd-0-clause
  tag identifier {T} 0bsd
  name bsd (?:zero|0) clause bsd
bsd
  grant bsd {G} bsd(?: style)? licen[cs]e
  text retain redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
  text reproduce redistributions in binary form must reproduce the above copyright notice
  name bsd bsd(?: style| type)? licen[cs]e
mpl-2.0
  tag identifier {T} mpl 2 0
  grant mozilla {G} mozilla public license{V} 2(?: 0)?
  grant mpl if a copy of the mpl was not distributed with this file
  url mozilla mozilla org mpl 2 0
  exact mozilla mozilla public license{V} 2(?: 0)?
  exact mpl mpl{V} 2(?: 0)?
mpl-1.1
  tag identifier {T} mpl 1 1
  exact mozilla mozilla public license{V} 1 1
  url mozilla mozilla org mpl mpl 1 1
mpl
  name mozilla mozilla public licen[cs]e
epl-2.0
  tag identifier {T} epl 2 0
  grant eclipse {G} eclipse public license{V} 2(?: 0)?
  url eclipse eclipse org legal epl (?:2 0|v20)
  exact eclipse eclipse public license{V} 2(?: 0)?
epl-1.0
  tag identifier {T} epl 1 0
  grant eclipse {G} eclipse public license{V} 1(?: 0)?
  url eclipse eclipse org legal epl v10
  exact eclipse eclipse public license{V} 1(?: 0)?
epl
  name eclipse eclipse public licen[cs]e
cddl-1.0
  tag identifier {T} cddl 1 [01]
  grant cddl {G} common development and distribution license(?: cddl)?
  name cddl cddl(?: 1 [01])?
  name development common development and distribution licen[cs]e
cpl-1.0
  tag identifier {T} cpl 1 0
  name common common public license(?: version 1(?: 0)?)?
eupl
  tag identifier {T} eupl 1 [012]
  grant eupl {G} eupl
  name eupl eupl(?: v?1 [012])?
  name european european union public licen[cs]e
artistic-2.0
  tag identifier {T} artistic 2 0
  exact artistic artistic license 2(?: 0)?
  url artistic opensource org licenses artistic license 2 0
artistic-1.0
  tag identifier {T} artistic 1 0(?: perl| cl8)?
  grant perl (?:under the same terms as|same license as) perl(?: itself)?
  name artistic (?:the )?artistic licen[cs]e
zlib
  tag identifier {T} zlib
  grant zlib {G} zlib(?: libpng)? licen[cs]e
  text misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
  name zlib zlib(?: libpng)? licen[cs]e
bsl-1.0
  tag identifier {T} bsl 1 0
  grant boost {G} boost software license(?: version 1(?: 0)?)?
  url boost boost org license 1 0
  name boost boost software licen[cs]e(?: version 1(?: 0)?)?
unlicense
  tag identifier {T} unlicense
  text unencumbered this is free and unencumbered software released into the public domain
  url unlicense unlicense org
  name unlicense the unlicense
wtfpl
  tag identifier {T} wtfpl
  name wtfpl wtfpl
psf-2.0
  tag identifier {T} (?:psf|python) 2 0(?: 1)?
  name python (?:psf|python software foundation) licen[cs]e(?: agreement)?
  name python python licen[cs]e
openssl
  tag identifier {T} openssl
  text openssl this product includes software developed by the openssl project
  name openssl openssl licen[cs]e
php
  tag identifier {T} php 3 0[01]?
  name php php licen[cs]e(?: version 3(?: 01)?)?
ofl-1.1
  tag identifier {T} ofl 1 [01](?: rfn| no rfn)?
  grant font {G} sil open font licen[cs]e
  url ofl scripts sil org ofl
  name font (?:sil )?open font licen[cs]e(?: version 1 1)?
postgresql
  tag identifier {T} postgresql
  name postgresql postgresql licen[cs]e
vim
  tag identifier {T} vim
  name vim vim licen[cs]e
curl
  tag identifier {T} curl
ncsa
  tag identifier {T} ncsa
  name ncsa (?:university of illinois )?ncsa(?: open source)? licen[cs]e
upl-1.0
  tag identifier {T} upl 1 0
  name permissive universal permissive licen[cs]e(?: v?1(?: 0)?)?
ms-pl
  tag identifier {T} ms pl
  name microsoft microsoft public licen[cs]e
ms-rl
  tag identifier {T} ms rl
  name microsoft microsoft reciprocal licen[cs]e
osl-3.0
  tag identifier {T} osl 3 0
  name osl (?:osl 3 0|open software license(?: osl)? (?:version |v )?3(?: 0)?)
  name open open software licen[cs]e
afl-3.0
  tag identifier {T} afl 3 0
  name academic academic free licen[cs]e(?: version 3(?: 0)?)?
sspl-1.0
  tag identifier {T} sspl 1 0
  name side server side public licen[cs]e
busl-1.1
  tag identifier {T} busl 1 1
  name business business source licen[cs]e(?: 1 1)?
elastic-2.0
  tag identifier {T} elastic 2 0
  name elastic elastic licen[cs]e(?: 2 0)?
openrail
  tag identifier {T} (?:bigscience |bigcode |creativeml )?openrail(?: m)?
  name rail (?:open )?responsible ai licen[cs]e(?: \S+){0,2}? rail
  name openrail (?:bigscience |bigcode |creativeml )?openrail(?: m)?
cc-by-nc-nd-4.0
  tag identifier {T} cc by nc nd 4 0
  grant nc {G} {CC} by nc nd 4(?: 0)?
  url nc creativecommons org licenses by nc nd 4 0
  exact nc cc by nc nd 4(?: 0)?
  exact attribution {CC} attribution non ?commercial no ?deriv(?:ative)?s 4(?: 0)?{I}
cc-by-nc-nd
  url nc creativecommons org licenses by nc nd
  name nc cc by nc nd
  name attribution {CC} attribution non ?commercial no ?deriv(?:ative)?(?:s|works)?
cc-by-nc-sa-4.0
  tag identifier {T} cc by nc sa 4 0
  grant nc {G} {CC} by nc sa 4(?: 0)?
  url nc creativecommons org licenses by nc sa 4 0
  exact nc cc by nc sa 4(?: 0)?
  exact attribution {CC} attribution non ?commercial share ?alike 4(?: 0)?{I}
cc-by-nc-sa
  url nc creativecommons org licenses by nc sa
  name nc cc by nc sa
  name attribution {CC} attribution non ?commercial share ?alike
cc-by-nc-4.0
  tag identifier {T} cc by nc 4 0
  grant nc {G} {CC} by nc 4(?: 0)?
  url nc creativecommons org licenses by nc 4 0
  exact nc cc by nc 4(?: 0)?
  exact attribution {CC} attribution non ?commercial 4(?: 0)?{I}
cc-by-nc
  url nc creativecommons org licenses by nc
  name nc cc by nc
  name attribution {CC} attribution non ?commercial
cc-by-nd-4.0
  tag identifier {T} cc by nd 4 0
  url creativecommons creativecommons org licenses by nd 4 0
  exact cc cc by nd 4(?: 0)?
  exact attribution {CC} attribution no ?deriv(?:ative)?s 4(?: 0)?{I}
cc-by-nd
  url creativecommons creativecommons org licenses by nd
  name cc cc by nd
cc-by-sa-4.0
  tag identifier {T} cc by sa 4 0
  grant sa {G} {CC} by sa 4(?: 0)?
  url sa creativecommons org licenses by sa 4 0
  exact sa cc by sa 4(?: 0)?
  exact attribution {CC} attribution share ?alike 4(?: 0)?{I}
cc-by-sa-3.0
  tag identifier {T} cc by sa 3 0
  grant sa {G} {CC} by sa 3(?: 0)?
  url sa creativecommons org licenses by sa 3 0
  exact sa cc by sa 3(?: 0)?
  exact attribution {CC} attribution share ?alike 3(?: 0)?{I}
cc-by-sa
  url sa creativecommons org licenses by sa
  name sa cc by sa
  name attribution {CC} attribution share ?alike
cc-by-4.0
  tag identifier {T} cc by 4 0
  grant cc {G} cc by 4(?: 0)?
  grant commons {G} creative commons by 4(?: 0)?
  url creativecommons creativecommons org licenses by 4 0
  exact cc cc by 4(?: 0)?
  exact attribution {CC} attribution 4(?: 0)?{I}
cc-by-3.0
  tag identifier {T} cc by 3 0
  grant cc {G} cc by 3(?: 0)?
  grant commons {G} creative commons by 3(?: 0)?
  url creativecommons creativecommons org licenses by 3 0
  exact cc cc by 3(?: 0)?
  exact attribution {CC} attribution 3(?: 0)?{I}
cc-by
  grant attribution {G} {CC} attribution
  url creativecommons creativecommons org licenses by
  name attribution {CC} attribution(?: licen[cs]e)?
  name creative creative commons by
cc0-1.0
  tag identifier {T} cc0 1 0
  grant cc0 {G} cc0(?: 1 0)?
  url creativecommons creativecommons org publicdomain zero 1 0
  exact cc0 cc0 1 0(?: universal)?
  name cc0 cc0
  name zero creative commons zero
public-domain
  tag identifier {T} public domain
  grant public (?:released|placed|dedicated|donated)(?: \S+){0,3}? (?:in|into|to) the public domain
  url creativecommons creativecommons org publicdomain mark 1 0
  hint public (?:is|are|in) (?:in )?the public domain
creative-commons
  name commons creative commons(?: \S+)? licen[cs]e
  grant commons {G} creative commons
  hint creativecommons creativecommons org
odbl-1.0
  tag identifier {T} odbl 1 0
  grant odbl {G} odbl
  url odbl opendatacommons org licenses odbl
  name database open (?:data commons open )?database licen[cs]e
odc-by-1.0
  tag identifier {T} odc by 1 0
  url opendatacommons opendatacommons org licenses by
  name attribution open data commons attribution licen[cs]e
pddl-1.0
  tag identifier {T} pddl 1 0
  url opendatacommons opendatacommons org licenses pddl
ogl-uk-3.0
  tag identifier {T} ogl uk 3 0
  grant government {G} open government licen[cs]e(?: v?3(?: 0)?)?
  name government open government licen[cs]e(?: v?3(?: 0)?)?
etalab-2.0
  tag identifier {T} etalab 2 0
  name ouverte licence ouverte(?: 2 0)?
dl-de-by-2.0
  tag identifier {T} dl de by 2 0
  name datenlizenz datenlizenz deutschland(?: namensnennung)?(?: 2 0)?
proprietary
  grant confidential proprietary and confidential
  grant trade (?:confidential )?trade secrets? of
  text unauthorized unauthorized (?:copying|reproduction|distribution|use)(?: \S+){0,6}? (?:is )?(?:strictly )?prohibited
  text reproduced no part of this (?:publication|work|book|document) may be reproduced
  name proprietary proprietary licen[cs]e
  name eula (?:end user licen[cs]e agreement|eula)
  hint reserved all rights reserved
unknown-license
  hint license {G} (?:following )?license
  hint licensed (?:dual |tri |multi )?licensed under
  hint lizenz (?:lizenziert|veröffentlicht|verfügbar) unter(?: \S+){0,3}? lizenz
  hint licence (?:sous|publié sous)(?: la)? licence
  hint licencia bajo(?: la)? licencia
"""


@dataclass(frozen=True)
class Rule:
    """One signature; rules are ordered, earlier ones win among equals."""

    order: int
    label: str
    kind: str
    keyword: str
    pattern: str
    base: bool = False

    @property
    def keywords(self) -> list[str]:
        return self.keyword.split("+")

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return KINDS[self.kind][1]

    def compiled(self) -> re.Pattern:
        """The regex on whole words of a text of words parted by single spaces."""
        p = self.pattern
        for short, long in SHORT.items():
            p = p.replace(short, long)
        return re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")


def load(text: str = RULES_TEXT, base: list[tuple[str, str, str]] = BASE) -> list[Rule]:
    """The base phrases, then the rules of ``text`` in their order."""
    out = [Rule(i, label, "name", word, re.escape(phrase).replace(r"\ ", " "), True) for i, (label, word, phrase) in enumerate(base)]
    label = None
    for line in text.splitlines():
        if line and not line.startswith(" "):
            label = line.strip()
        elif line.strip():
            kind, word, pattern = line.strip().split(" ", 2)
            out.append(Rule(len(out), label, kind, word, pattern))
    return out
