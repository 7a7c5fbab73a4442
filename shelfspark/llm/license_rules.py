"""Signature rules for licences, over words joined by one space.

A rule is ``label | keyword | pattern``: the pattern is only tried on texts
that hold the keyword as a word.  Rules stand in sections by priority, 0 first;
within a section earlier rules go before later ones.  In patterns ``V`` stands
for an optional ``version`` or ``v`` before a number; the digits of a version
are words of their own (``2.0`` is ``2 0``).
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    no: int
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern


#: How much a detection of each priority tells: identifiers, names with version or full grants, names, notices.
WEIGHTS = (0.99, 0.9, 0.7, 0.3)

#: Identifiers that follow "SPDX-License-Identifier:"; each gives a rule of priority 0.
IDENTIFIERS = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apl-1.0
apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0
cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0
cddl-1.1 cecill-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.0
eupl-1.1 eupl-1.2 fair ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-1.0-only gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
gpl-3.0-or-later hpnd icu ijg imagemagick ipl-1.0 isc lgpl-2.0 lgpl-2.0-only lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
lgpl-3.0-or-later libpng libtiff lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa npl-1.1 odbl-1.0 odc-by-1.0 ofl-1.0
ofl-1.1 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 ruby sissl sleepycat
sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.0 zpl-2.1
"""

#: Priority 1: full names with their version, and sentences by which a licence grants its rights.
NAMED = """
agpl-3.0 | affero | (?:gnu )?affero general public license V3(?: 0)?
agpl-1.0 | affero | affero general public license V1(?: 0)?
lgpl-2.0 | library | (?:gnu )?library general public license V2(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license V2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public license V3(?: 0)?
lgpl-2.1 | lgpl | lgpl V2 1
lgpl-3.0 | lgpl | lgpl V3(?: 0)?
lgpl-2.1 | lgplv2 | lgplv2 1
lgpl-3.0 | lgplv3 | lgplv3
gpl-1.0 | general | (?:gnu )?general public license V1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public license V2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public license V3(?: 0)?
gpl-2.0 | general | general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | general | general public license as published by the free software foundation (?:either )?version 3
gpl-2.0 | gpl | (?:gnu )?gpl V2(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl V3(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: 0)?
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | agpl | agpl V3(?: 0)?
gfdl-1.1 | documentation | (?:gnu )?free documentation license V1 1
gfdl-1.2 | documentation | (?:gnu )?free documentation license V1 2
gfdl-1.3 | documentation | (?:gnu )?free documentation license V1 3
apache-1.0 | apache | apache (?:software )?license V1 0
apache-1.1 | apache | apache (?:software )?license V1 1
apache-2.0 | apache | apache (?:software )?license V2(?: 0)?
apache-2.0 | apache | licensed under the apache license version 2 0 the license
apache-2.0 | apache | www apache org licenses license 2 0
mpl-1.0 | mozilla | mozilla public license V1 0
mpl-1.1 | mozilla | mozilla public license V1 1
mpl-2.0 | mozilla | mozilla public license V2(?: 0)?
mpl-2.0 | mozilla | mozilla org mpl 2 0
mpl-1.1 | mpl | mpl V1 1
mpl-2.0 | mpl | mpl V2(?: 0)?
epl-1.0 | eclipse | eclipse public license V1(?: 0)?
epl-2.0 | eclipse | eclipse public license V2(?: 0)?
edl-1.0 | eclipse | eclipse distribution license V1(?: 0)?
cpl-1.0 | common | common public license V1(?: 0)?
ipl-1.0 | ibm | ibm public license V1(?: 0)?
cddl-1.0 | distribution | common development and distribution license V1 0
cddl-1.1 | distribution | common development and distribution license V1 1
cddl-1.0 | cddl | cddl V1 0
eupl-1.1 | european | european union public licen[cs]e V1 1
eupl-1.2 | european | european union public licen[cs]e V1 2
eupl-1.2 | eupl | eupl V1 2
artistic-1.0 | artistic | artistic license V1(?: 0)?
artistic-2.0 | artistic | artistic license V2(?: 0)?
afl-2.1 | academic | academic free license V2 1
afl-3.0 | academic | academic free license V3(?: 0)?
osl-2.1 | open | open software license V2 1
osl-3.0 | open | open software license V3(?: 0)?
bsl-1.0 | boost | boost software license V1(?: 0)?
busl-1.1 | business | business source license V1 1
sspl-1.0 | server | server side public license V1
elastic-2.0 | elastic | elastic license V2(?: 0)?
ofl-1.1 | font | (?:sil )?open font license V1 1
ofl-1.1 | ofl | ofl V1 1
cecill-2.1 | cecill | cecill V2 1
cecill-b | cecill | cecill b license
cecill-c | cecill | cecill c license
cc0-1.0 | cc0 | cc0 1 0 universal
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
cc-by-nc-nd-4.0 | noncommercial | attribution noncommercial noderivatives 4 0(?: international)?
cc-by-nc-nd-3.0 | noncommercial | attribution noncommercial noderivs 3 0(?: unported)?
cc-by-nc-sa-4.0 | noncommercial | attribution noncommercial sharealike 4 0(?: international)?
cc-by-nc-sa-3.0 | noncommercial | attribution noncommercial sharealike 3 0(?: unported)?
cc-by-nc-4.0 | noncommercial | attribution noncommercial 4 0(?: international)?
cc-by-nc-3.0 | noncommercial | attribution noncommercial 3 0(?: unported)?
cc-by-nd-4.0 | noderivatives | attribution noderivatives 4 0(?: international)?
cc-by-nd-3.0 | noderivs | attribution noderivs 3 0(?: unported)?
cc-by-sa-4.0 | sharealike | attribution sharealike 4 0(?: international)?
cc-by-sa-3.0 | sharealike | attribution sharealike 3 0(?: unported)?
cc-by-sa-2.5 | sharealike | attribution sharealike 2 5(?: generic)?
cc-by-sa-2.0 | sharealike | attribution sharealike 2 0(?: generic)?
cc-by-4.0 | commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | commons | creative commons attribution 3 0(?: unported)?
cc-by-2.5 | commons | creative commons attribution 2 5(?: generic)?
cc-by-2.0 | commons | creative commons attribution 2 0(?: generic)?
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.0 | cc | cc by 2 0
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd(?: \\d \\d)?
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa(?: \\d \\d)?
cc-by-nc | creativecommons | creativecommons org licenses by nc(?: \\d \\d)?
cc-by-nd | creativecommons | creativecommons org licenses by nd(?: \\d \\d)?
cc-by-sa | creativecommons | creativecommons org licenses by sa(?: \\d \\d)?
cc-by | creativecommons | creativecommons org licenses by(?: \\d \\d)?
odbl-1.0 | database | open (?:data commons )?(?:open )?database license V1 0
odc-by-1.0 | commons | open data commons attribution license V1 0
pddl-1.0 | dedication | public domain dedication and license V1 0
zpl-2.1 | zope | zope public license V2 1
zpl-2.0 | zope | zope public license V2 0
php-3.01 | php | php license V3 01
php-3.0 | php | php license V3 0
python-2.0 | python | python (?:software foundation )?license V2(?: 0)?
w3c | w3c | w3c software (?:notice and|and document) license
lppl-1.3c | latex | latex project public license V1 3c?
qpl-1.0 | q | q public license V1 0
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
upl-1.0 | permissive | universal permissive license V1 0
mulanpsl-2.0 | mulan | mulan (?:permissive software license|psl) V2
blueoak-1.0.0 | oak | blue oak model license 1 0 0
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-4-clause | bsd | (?:4|four) clause bsd(?: license)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: license)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: license)?
bsd-4-clause | bsd | bsd (?:4|four) clause(?: license)?
bsd-3-clause | bsd | bsd (?:3|three) clause(?: license)?
bsd-2-clause | bsd | bsd (?:2|two) clause(?: license)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd(?: license)?
bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: license)?
zlib | misrepresented | the origin of this software must not be misrepresented
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
beerware | beer | the beer ware license
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
"""

#: Priority 2: names without a version.
PLAIN = """
agpl | affero | (?:gnu )?affero general public license
lgpl | lesser | (?:gnu )?lesser general public license
lgpl | library | (?:gnu )?library general public license
gpl | general | (?:gnu )?general public license
gpl | gpl | gnu gpl
lgpl | lgpl | gnu lgpl
agpl | agpl | gnu agpl
gfdl | documentation | (?:gnu )?free documentation license
apache | apache | apache (?:software )?license
mpl | mozilla | mozilla public license
epl | eclipse | eclipse public license
cpl | common | common public license
cddl | distribution | common development and distribution license
eupl | european | european union public licen[cs]e
artistic | artistic | artistic license
afl | academic | academic free license
osl | open | open software license
bsl | boost | boost software license
busl | business | business source license
sspl | server | server side public license
elastic | elastic | elastic license
ofl | font | (?:sil )?open font license
mit | mit | mit licen[cs]ed?
mit | mit | licensed under (?:the )?mit
mit | expat | expat license
x11 | x11 | x11 license
isc | isc | isc license
bsd | bsd | bsd (?:style )?licen[cs]ed?
bsd | berkeley | berkeley software distribution license
zlib | zlib | zlib(?: libpng)? license
libpng | libpng | libpng license
openssl | openssl | openssl license
postgresql | postgresql | postgresql license
python | python | python software foundation license
php | php | php license
ruby | ruby | ruby license
vim | vim | vim license
ncsa | ncsa | (?:university of illinois )?ncsa open source license
icu | icu | icu license
unicode | unicode | unicode (?:data files and software )?license agreement
sleepycat | sleepycat | sleepycat license
imagemagick | imagemagick | imagemagick license
zpl | zope | zope public license
lppl | latex | latex project public license
qpl | trolltech | trolltech q public license
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl(?: license)?
cecill | cecill | cecill license
mulanpsl | mulan | mulan psl
odbl | odbl | odbl(?: license)?
odbl | database | open database license
cc0 | cc0 | cc0(?: license| waiver| public domain dedication)
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-sa | cc | cc by sa
cc-by | cc | cc by
cc-by-nc-nd | noncommercial | creative commons attribution noncommercial (?:noderivatives|noderivs)
cc-by-nc-sa | noncommercial | creative commons attribution noncommercial sharealike
cc-by-nc | noncommercial | creative commons attribution noncommercial
cc-by-sa | sharealike | creative commons attribution sharealike
cc-by | commons | creative commons attribution
creative-commons | commons | creative commons licen[cs]e
public-domain | dedicated | dedicated to the public domain
public-domain | domain | (?:released|placed|is) (?:into|in) the public domain
openrail | openrail | openrail(?: m)?(?: license)?
llama-community | llama | llama (?:\\d )?community license
gemma | gemma | gemma terms of use
community-data | community | community data license agreement
oracle-binary | oracle | oracle binary code license
jdom | jdom | jdom license
json | good | the software shall be used for good not evil
"""

#: Priority 3: notices that reserve or grant rights without naming a licence.
NOTICES = """
reserved | reserved | all rights reserved
reserved | reserved | some rights reserved
reserved | reserves | reserves all rights
reserved | derechos | todos los derechos reservados
reserved | droits | tous droits r\xc3\xa9serv\xc3\xa9s
reserved | rechte | alle rechte vorbehalten
proprietary | proprietary | (?:confidential and )?proprietary (?:information|license|and confidential)
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use) (?:\\S+ ){0,6}is strictly prohibited
proprietary | reproduced | (?:may|must|shall) not be reproduced (?:\\S+ ){0,6}without (?:prior |express |the |written )*permission
proprietary | agreement | end user license agreement
copyright | copyright | copyright(?: c)? (?:19|20)\\d\\d
copyright | \xc2\xa9 | \xc2\xa9 (?:19|20)\\d\\d
copyright | copyrighted | copyrighted (?:material|work)
permissive | attribution | free to use with attribution
permissive | royalty | royalty free license
trademark | trademarks | (?:are|is) (?:registered )?trademarks of
trademark | trademark | (?:are|is) (?:a )?(?:registered )?trademark of
warranty | provided | provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
warranty | liable | in no event shall (?:the )?(?:authors?|copyright holders?|contributors?) (?:\\S+ ){0,6}be liable
see-license | license | see (?:the )?license(?: file| md| txt)?(?: in the project root)? for (?:details|more information|license information)
"""


def _section(text: str, priority: int) -> list[tuple[int, str, str, str]]:
    rows = [line.split(" | ") for line in text.strip().splitlines()]
    return [(priority, label, keyword, pattern.replace(" V", " (?:version |version v ?|v ?)?")) for label, keyword, pattern in rows]


def _identifier(name: str) -> tuple[int, str, str, str]:
    return (0, name, "spdx", "spdx license identifier " + re.sub(r"[^a-z0-9]+", " ", name))


def rules() -> list[Rule]:
    """All rules, the first to be preferred first; longer identifiers go before those they begin with."""
    named = sorted((_identifier(x) for x in IDENTIFIERS.split()), key=lambda r: (-len(r[3]), r[1]))
    found = [*named, *_section(NAMED, 1), *_section(PLAIN, 2), *_section(NOTICES, 3)]
    return [Rule(i, p, label, k.encode("latin-1"), re.compile(b"(?<= )(?:" + pattern.encode("latin-1") + b")(?= )")) for i, (p, label, k, pattern) in enumerate(found)]


RULES = rules()
