"""License detection by ordered signature rules, in DataFrame functions only.

Rules are regexes over lower-cased text: hand-written wordings of notices and licence texts, and a table of licences by a
few forms of mention (tag or tag expression, address, notice, name with version, name, identifier), in English, German, French and Spanish.
Names hold a hyphen or white space between their words ("MPL-2.0", "MPL 2.0"). A document without a licensing word is passed over; in the
others a rule runs only where its keywords stand in the text. Rules are ordered by
priority; a detection that lies within another of the same or a better priority is suppressed (of equal
intervals the better priority, then the earlier rule stays). All is computed within the row: no shuffle, and
repeated rows or ids need no care.

A null text is empty; an empty text has no words, no labels, null positions and score 0; extra columns are kept
by ``detect`` (its own columns are named by the caller and replace equal names); an empty table stays empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.spans import anchored, spans_of

#: Label | keywords (one of them stands in any text with the name) | name as a regex | address as a regex. Labels are SPDX short names in lower case.
LICENCES = r"""
mit | mit | mit(?: \(expat\))? | opensource\.org/licenses?/mit
mit-0 | mit-0 | mit-0|mit no attribution | opensource\.org/licenses?/mit-0
apache-1.1 | apache | apache(?: software)? license,? (?:version |v)?1\.1 | apache\.org/licenses/license-1\.1
apache-2.0 | apache | apache(?: software)?(?: license)?,? (?:version |v)?2(?:\.0)? | apache\.org/licenses/license-2\.0
gpl-2.0 | gpl,general public | (?:gnu )?(?:general public license|gpl)(?:,| \(gpl\))* ?(?:version |v)?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gpl,general public | (?:gnu )?(?:general public license|gpl)(?:,| \(gpl\))* ?(?:version |v)?3(?:\.0)? | gnu\.org/licenses/gpl-3\.0
lgpl-2.1 | lgpl,lesser general | (?:gnu )?(?:lesser general public license|lgpl)(?:,| \(lgpl\))* ?(?:version |v)?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | lgpl,lesser general | (?:gnu )?(?:lesser general public license|lgpl)(?:,| \(lgpl\))* ?(?:version |v)?3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | agpl,affero | (?:gnu )?(?:affero general public license|agpl)(?:,| \(agpl\))* ?(?:version |v)?3(?:\.0)? | gnu\.org/licenses/agpl-3\.0
gfdl-1.3 | free documentation | (?:gnu )?free documentation license,? (?:version |v)?1\.3 | gnu\.org/licenses/fdl-1\.3
bsd-2-clause | bsd | (?:simplified bsd|bsd[- ]2[- ]clause|2[- ]clause bsd) | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd | (?:new bsd|modified bsd|bsd[- ]3[- ]clause|3[- ]clause bsd) | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd | (?:original bsd|bsd[- ]4[- ]clause|4[- ]clause bsd) | opensource\.org/licenses?/bsd-4-clause
0bsd | bsd | (?:0bsd|zero[- ]clause bsd) | opensource\.org/licenses?/0bsd
isc | isc | isc | opensource\.org/licenses?/isc
mpl-1.1 | mpl,mozilla | (?:mozilla public license|mpl),? (?:version |v)?1\.1 | mozilla\.org/(?:en-us/)?mpl/1\.1
mpl-2.0 | mpl,mozilla | (?:mozilla public license|mpl),? (?:version |v)?2(?:\.0)? | mozilla\.org/(?:en-us/)?mpl/2\.0
epl-1.0 | epl,eclipse | (?:eclipse public license|epl),? (?:version |v)?1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | epl,eclipse | (?:eclipse public license|epl),? (?:version |v)?2(?:\.0)? | eclipse\.org/legal/epl-(?:v20|2\.0)
cddl-1.0 | cddl,common development | (?:common development and distribution license|cddl),? (?:version |v)?1\.0 | opensource\.org/licenses?/cddl-1\.0
eupl-1.2 | eupl,european union | (?:european union public licen[cs]e|eupl),? (?:version |v)?1\.2 | joinup\.ec\.europa\.eu/(?:\S*/)?eupl
artistic-2.0 | artistic | artistic license,? (?:version |v)?2(?:\.0)? | opensource\.org/licenses?/artistic-2\.0
bsl-1.0 | boost | boost software license,? (?:version |v)?1\.0 | boost\.org/license_1_0
zlib | zlib | zlib(?:/libpng)? | opensource\.org/licenses?/zlib
unlicense | unlicense | unlicense | unlicense\.org
wtfpl | wtfpl,do what the | (?:wtfpl|do what the fuck you want to public license) | wtfpl\.net
psf-2.0 | python | python software foundation license(?:,? (?:version |v)?2)? | python\.org/(?:\S*/)?license
postgresql | postgresql | postgresql | opensource\.org/licenses?/postgresql
ofl-1.1 | ofl,open font | (?:sil open font license|ofl)(?:,? (?:version |v)?1\.1)? | scripts\.sil\.org/ofl
openssl | openssl | openssl | openssl\.org/source/license
afl-3.0 | academic | academic free license,? (?:version |v)?3(?:\.0)? | opensource\.org/licenses?/afl-3\.0
osl-3.0 | osl,open software | (?:open software license|osl),? (?:version |v)?3(?:\.0)? | opensource\.org/licenses?/osl-3\.0
ms-pl | ms-pl,microsoft public | (?:microsoft public license|ms-pl) | opensource\.org/licenses?/ms-pl
odbl-1.0 | odbl,open database | (?:open database license|odbl)(?:,? (?:version |v)?1\.0)? | opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by,open data commons | (?:open data commons attribution license|odc-by)(?:,? (?:version |v)?1\.0)? | opendatacommons\.org/licenses/by
cc0-1.0 | cc0,creative commons | (?:cc0|creative commons zero)(?:[ -]?1\.0)? | creativecommons\.org/publicdomain/zero
cc-by-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by|creative commons attribution)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | cc by,cc-by,creative commons | (?:cc[ -]by|creative commons attribution)[ -](?:unported )?3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-sa-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]sa|creative commons attribution[ -]share ?alike)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]sa|creative commons attribution[ -]share ?alike)[ -](?:unported )?3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]nc|creative commons attribution[ -]non-?commercial)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]nd|creative commons attribution[ -]no ?deriv(?:ative)?s)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non-?commercial[ -]share ?alike)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0 | cc by,cc-by,creative commons | (?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non-?commercial[ -]no ?deriv(?:ative)?s)[ -](?:international )?4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
public-domain | public domain | public domain | creativecommons\.org/publicdomain/mark
"""  # fmt: skip
#: Forms of mention by priority: regex around {label}, {name} or {url}; keyword that must stand in the text; confidence.
FORMS = (
    (r"(?:spdx-license-identifier:\s*\(*|(?<=\sor\s)|(?<=\sand\s)|(?<=\sor\s\()|(?<=\sand\s\()){label}(?:-only|-or-later|\+)?(?![a-z0-9.-])", "spdx-license", 1.0),
    (r"(?:https?://)?(?:www\.)?(?:{url}|spdx\.org/licenses/{label}(?![a-z0-9-]))", "://|www.|.org|.net|.eu", 0.95),
    (
        r"(?:(?:licensed|released|distributed|available|published|provided|covered)\s+(?:only\s+)?(?:under|by)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
        r"|(?:lizenziert|veröffentlicht|verfügbar)\s+unter\s+(?:den\s+bedingungen\s+)?(?:der\s+)?|unter\s+der\s+(?:lizenz\s+)?"
        r"|sous\s+(?:la\s+)?licence\s+|(?:distribué|publié)e?\s+sous\s+(?:les\s+termes\s+de\s+)?(?:la\s+)?(?:licence\s+)?"
        r"|(?:bajo|con)\s+(?:los\s+términos\s+de\s+)?(?:la\s+)?licencia\s+)"
        r"{name}(?:\s+licen[cs]e|[\s-]lizenz)?(?![a-z0-9-]|\.[0-9])",
        "under| by|unter|sous|bajo|con", 0.9,
    ),
    (r"(?:licen[cs]e\s*[:=]\s*[\x22']?|lizenz\s*[:=]\s*[\x22']?|licen(?:cia|ce)\s+)\(?{name}(?![a-z0-9-]|\.[0-9])", "licen|lizenz", 0.85),
    (r"(?<![a-z0-9-]){name}(?:\s+licen[cs]e(?![a-z0-9])|-licen[cs]ed?(?![a-z0-9])|[\s-]lizenz(?![a-z0-9]))", "licen|lizenz", 0.7),
    (r"(?<![a-z0-9./-]){identifier}(?:-only|-or-later|\+)?(?![a-z0-9-]|\.[0-9])", "", 0.65),
)
#: What may stand between the words of a name.
NAMED = r"[\s-]"
#: Labels that are no words of other meaning: they count wherever they stand.
IDENTIFIER = re.compile(r"\d\.\d|clause|^0bsd$|^ms-pl$|^mit-0$")
#: Rules of their own wording: label | keyword that must stand in the text | regex | confidence. Spaces in a regex are any white
#: space. Their priority comes before names and after tags, addresses and notices.
WORDINGS = r"""
mit | hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software | 0.95
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies | 0.95
mit-0 | furnished | to permit persons to whom the software is furnished to do so\. | 0.6
isc | with or without fee | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided | 0.95
0bsd | with or without fee | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. | 0.95
hpnd | without fee | permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted | 0.9
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted | 0.9
bsd-3-clause | endorse or promote | neither the names? of (?:[^\s.;]+ ){1,12}?nor the names of (?:[^\s.;]+ ){1,6}?may be used to endorse or promote products derived from this software | 0.95
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display | 0.95
bsd | bsd | bsd[- ]style licen[cs]e | 0.8
bsd | bsd | licen[cs]e ?[:=] ?[\x22']?bsd(?![a-z0-9-]) | 0.85
bsd | bsd | (?:under|by) (?:the |a )?(?:terms of the )?bsd(?: licen[cs]e)?(?![a-z0-9-]) | 0.85
bsd | bsd | (?<![a-z0-9-])bsd licen[cs]e | 0.7
apache-2.0 | apache | apache licen[cs]e,? version 2(?:\.0)?(?![0-9.]*[0-9]) | 0.9
apache-2.0 | apache | apache licen[cs]e,? v?2\.0(?![0-9]) | 0.9
apache-2.0 | apache | apache-2\.0(?![0-9]) | 0.85
apache-2.0 | applicable | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an | 0.95
apache-2.0 | in compliance | you may not use this file except in compliance with the license | 0.9
apache-2.0 | perpetual, worldwide | hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license | 0.9
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation | 0.7
gpl-1.0 | general public | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 1(?![.0-9]) | 0.95
gpl-2.0 | general public | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 2(?![.0-9]) | 0.95
gpl-3.0 | general public | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 3(?![.0-9]) | 0.95
gpl-2.0 | general public | gnu general public license,? (?:version |v)2(?:\.0)?(?![.0-9]) | 0.9
gpl-3.0 | general public | gnu general public license,? (?:version |v)3(?:\.0)?(?![.0-9]) | 0.9
gpl-2.0 | general public | gnu general public license version 2, june 1991 | 0.95
gpl-3.0 | general public | gnu general public license version 3, 29 june 2007 | 0.95
gpl-2.0 | gpl | (?<![a-z0-9])(?:gnu )?gpl[- ]?v?2(?:\.0)?(?![a-z0-9.]) | 0.75
gpl-3.0 | gpl | (?<![a-z0-9])(?:gnu )?gpl[- ]?v?3(?:\.0)?(?![a-z0-9.]) | 0.75
gpl | a copy of the gnu | you should have received a copy of the gnu general public license | 0.9
gpl | free software | this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license | 0.9
gpl | licen | licen[cs]e ?[:=] ?[\x22']?(?:gnu )?gpl(?![a-z0-9-]) | 0.8
lgpl-2.0 | library general | gnu library general public license as published by the free software foundation[,;:]? (?:either )?version 2(?![.0-9]) | 0.95
lgpl-2.1 | lesser general | gnu lesser general public license as published by the free software foundation[,;:]? (?:either )?version 2\.1 | 0.95
lgpl-3.0 | lesser general | gnu lesser general public license as published by the free software foundation[,;:]? (?:either )?version 3(?![.0-9]) | 0.95
lgpl-2.1 | lesser general | (?:gnu )?lesser general public license,? (?:version |v)2\.1 | 0.9
lgpl-3.0 | lesser general | (?:gnu )?lesser general public license,? (?:version |v)3(?:\.0)?(?![.0-9]) | 0.9
lgpl-2.1 | lgpl | (?<![a-z0-9])lgpl[- ]?v?2\.1 | 0.75
lgpl-3.0 | lgpl | (?<![a-z0-9])lgpl[- ]?v?3(?:\.0)?(?![a-z0-9.]) | 0.75
lgpl | a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public license | 0.9
lgpl | lesser general | (?:under )?the terms of the gnu lesser general public license | 0.8
agpl-3.0 | affero | gnu affero general public license as published by the free software foundation[,;:]? (?:either )?version 3(?![.0-9]) | 0.95
agpl-3.0 | affero | (?:gnu )?affero general public license,? (?:version |v)3(?:\.0)? | 0.9
agpl | a copy of the gnu | you should have received a copy of the gnu affero general public license | 0.9
gfdl | free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license | 0.95
gfdl-1.3 | free documentation | gnu free documentation license,? (?:version |v)1\.3 | 0.95
gfdl-1.2 | free documentation | gnu free documentation license,? (?:version |v)1\.2 | 0.95
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0 | 0.95
mpl-1.1 | mozilla | subject to the mozilla public license version 1\.1 | 0.95
mpl-2.0 | mozilla | mozilla public license,? (?:version |v\. ?|v)?2\.0 | 0.9
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0 | 0.95
epl-2.0 | eclipse | eclipse public license,? (?:version |v\. ?|v)?2\.0 | 0.9
cddl-1.0 | common development | common development and distribution license,? (?:\(the \x22license\x22\)|version 1\.0) | 0.85
zlib | origin of this software | the origin of this software must not be misrepresented; you must not claim | 0.95
zlib | express or implied warranty | this software is provided ['\x22`]as-is['\x22`]?,? without any express or implied warranty | 0.7
bsl-1.0 | boost | boost software license[ ,-]{1,3}version 1\.0 | 0.95
bsl-1.0 | organization | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation | 0.95
artistic-2.0 | artistic | the artistic license 2\.0 | 0.95
artistic-1.0 | artistic | under the (?:terms of the )?artistic license(?! 2) | 0.75
unlicense | unencumbered | this is free and unencumbered software released into the public domain | 0.95
unlicense | anyone | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software | 0.95
wtfpl | what the fuck you want | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed\. do what the fuck you want | 0.9
ofl-1.1 | open font | this font software is licensed under the sil open font license,? version 1\.1 | 0.95
ofl-1.1 | font software | permission is hereby granted, free of charge, to any person obtaining a copy of the font software | 0.95
psf-2.0 | psf | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license | 0.9
openssl | openssl | this product includes software developed by the openssl project | 0.9
ms-pl | microsoft | microsoft public license \(ms-pl\) | 0.95
ms-rl | microsoft | microsoft reciprocal license \(ms-rl\) | 0.95
eupl-1.2 | european union | european union public licen[cs]e,? (?:v\.? ?|version )1\.2 | 0.95
mulan-2.0 | mulan | mulan permissive software license,? (?:v|version )2 | 0.9
busl-1.1 | business source | business source license,? (?:v|version )?1\.1 | 0.9
sspl-1.0 | server side | server side public license,? (?:v|version )1 | 0.9
elastic-2.0 | elastic | elastic license,? (?:v|version )?2(?:\.0)? | 0.9
json | good, not evil | the software shall be used for good, not evil | 0.95
beerware | beer-ware | the beer-ware license | 0.95
cc0-1.0 | creative commons | creative commons cc0 1\.0 universal | 0.95
cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights | 0.9
cc-by-4.0 | creative commons | creative commons attribution 4\.0(?: international)?(?: public)? | 0.95
cc-by-3.0 | creative commons | creative commons attribution 3\.0(?: unported)? | 0.95
cc-by-2.0 | creative commons | creative commons attribution 2\.0(?: generic)? | 0.95
cc-by-sa-4.0 | creative commons | creative commons attribution[- ]share ?-?alike 4\.0(?: international)? | 0.95
cc-by-sa-3.0 | creative commons | creative commons attribution[- ]share ?-?alike 3\.0(?: unported)? | 0.95
cc-by-nd-4.0 | creative commons | creative commons attribution[- ]no ?-?deriv(?:ative)?s 4\.0(?: international)? | 0.95
cc-by-nc-4.0 | creative commons | creative commons attribution[- ]non-?commercial 4\.0(?: international)? | 0.95
cc-by-nc-3.0 | creative commons | creative commons attribution[- ]non-?commercial 3\.0(?: unported)? | 0.95
cc-by-nc-sa-4.0 | creative commons | creative commons attribution[- ]non-?commercial[- ]share ?-?alike 4\.0(?: international)? | 0.95
cc-by-nc-sa-3.0 | creative commons | creative commons attribution[- ]non-?commercial[- ]share ?-?alike 3\.0(?: unported)? | 0.95
cc-by-nc-nd-4.0 | creative commons | creative commons attribution[- ]non-?commercial[- ]no ?-?deriv(?:ative)?s 4\.0(?: international)? | 0.95
cc-by-sa | cc | (?<![a-z0-9])cc[- ]by-sa(?![a-z0-9-]) | 0.7
cc-by-nc | cc | (?<![a-z0-9])cc[- ]by-nc(?![a-z0-9-]) | 0.7
cc-by-nc-sa | cc | (?<![a-z0-9])cc[- ]by-nc-sa(?![a-z0-9]) | 0.75
cc-by-nc-nd | cc | (?<![a-z0-9])cc[- ]by-nc-nd(?![a-z0-9]) | 0.75
creative-commons | creative commons | creative commons licen[cs]e | 0.6
odbl-1.0 | open database | open database license \(odbl\) | 0.95
mit | mit | (?<![a-z0-9-])mit(?=\s?(?:/|or|and)\s?(?:the\s)?(?:apache|bsd|gpl|lgpl)) | 0.85
apache-2.0 | apache | (?<![a-z0-9-])apache(?:[- ]2\.0)?(?=\s?(?:/|or|and)\s?(?:the\s)?mit(?![a-z0-9])) | 0.85
bsd | bsd | (?<![a-z0-9-])bsd(?=\s?(?:/|or|and)\s?(?:the\s)?(?:mit|apache|gpl)(?![a-z0-9])) | 0.8
gpl | gpl | (?<![a-z0-9-])gpl(?=\s?(?:/|or|and)\s?(?:the\s)?(?:mit|apache|bsd)(?![a-z0-9])) | 0.8
mit | mit | (?:(?<=apache/)|(?<=2\.0/)|(?<=bsd/)|(?<=gpl/)|(?<=apache\sor\s)|(?<=2\.0\sor\s)|(?<=bsd\sor\s)|(?<=gpl\sor\s))mit(?![a-z0-9-]) | 0.85
apache-2.0 | apache | (?:(?<=mit/)|(?<=mit\sor\s)|(?<=mit\sand\s))apache(?:[- ]2\.0)?(?![a-z0-9]) | 0.85
bsd | bsd | (?:(?<=mit/)|(?<=mit\sor\s)|(?<=mit\sand\s)|(?<=apache/)|(?<=gpl/))bsd(?![a-z0-9-]) | 0.8
gpl | gpl | (?:(?<=mit/)|(?<=mit\sor\s)|(?<=bsd/)|(?<=bsd\sor\s)|(?<=artistic/))gpl(?![a-z0-9-]) | 0.8
dual | dual | dual[- ]licen[cs]ed | 0.6
proprietary | rights | (?<![a-z0-9])all rights reserved(?![a-z0-9]) | 0.6
proprietary | proprietary | (?:is |are |this )(?:confidential and )?proprietary (?:and confidential|software|information) | 0.7
proprietary | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:[^\s.]+ ){0,8}is (?:strictly )?prohibited | 0.8
proprietary | prior written | may not be (?:reproduced|copied|distributed)(?: [^\s.]+){0,10} without (?:the )?(?:express )?prior written (?:permission|consent) | 0.7
proprietary | end user | end[- ]user licen[cs]e agreement | 0.7
public-domain | public | (?<![a-z0-9])(?:released|placed|put|donated|dedicated) (?:into|in|to) the public domain(?![a-z0-9-]) | 0.9
public-domain | public | (?<![a-z0-9])dedicate[sd]? (?:[^\s.]+ ){1,8}to the public domain(?![a-z0-9-]) | 0.9
public-domain | no known | no known copyright restrictions | 0.8
mit | without warranty | the software is provided [\x22']?as is[\x22']?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability | 0.8
bsd | express or implied | this software is provided by (?:the )?[^\n.;]{1,120}?[\x22'`]*as is[\x22']* and any express or implied warranties | 0.8
mit | mit | (?<![a-z0-9-])mit[- ]licen[cs]ed | 0.8
apache-2.0 | apache | (?<![a-z0-9-])apache(?:[- ]2(?:\.0)?)?[- ]licen[cs]ed | 0.7
bsd | bsd | (?<![a-z0-9-])bsd[- ]licen[cs]ed | 0.8
gpl | gpl | (?<![a-z0-9-])(?:gnu )?gpl(?:v?[23])?[- ]licen[cs]ed | 0.75
lgpl-2.0 | lgpl | (?<![a-z0-9])lgpl[- ]?v?2(?:\.0)?(?![.0-9a-z]) | 0.75
agpl-3.0 | agpl | (?<![a-z0-9])agpl[- ]?v?3(?:\.0)?(?![.0-9a-z]) | 0.75
bsl-1.0 | boost | (?<![a-z0-9])boost (?:software )?licen[cs]e | 0.8
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e | 0.8
gfdl-1.2 | gfdl | (?<![a-z0-9])gfdl[- ]?v?1\.2 | 0.75
gfdl-1.3 | gfdl | (?<![a-z0-9])gfdl[- ]?v?1\.3 | 0.75
ncsa | ncsa | (?:university of illinois[/ ])?ncsa open source licen[cs]e | 0.95
ncsa | ncsa | (?:licen[cs]e ?[:=] ?[\x22']?|licensed under (?:the )?)(?:uiuc/|u of i/)?ncsa(?![a-z0-9-]) | 0.85
ncsa | ncsa | (?<![a-z0-9-])ncsa licen[cs]e | 0.7
php-3.01 | php | php licen[cs]e,? (?:version |v)?3\.01 | 0.95
php-3.0 | php | php licen[cs]e,? (?:version |v)?3\.0(?![0-9]) | 0.95
w3c | w3c | w3c(?:\(r\)|®)? (?:software )?(?:and |notice and )?(?:document )?(?:notice and )?licen[cs]e | 0.9
w3c | w3c | w3c software licen[cs]e | 0.9
python-2.0 | python | python software foundation licen[cs]e version 2 | 0.9
zpl-2.1 | zope | zope public licen[cs]e(?: \(zpl\))?,? (?:version |v)?2\.1 | 0.9
ruby | ruby | (?:licensed under (?:the )?|same (?:terms|license) as )ruby(?:'s)?(?: licen[cs]e)?(?![a-z0-9-]) | 0.75
perl | perl | under the same terms as (?:the )?perl(?: ?5)?(?: itself)? | 0.85
vim | vim | (?<![a-z0-9-])vim licen[cs]e | 0.75
curl | curl | (?<![a-z0-9-])curl licen[cs]e | 0.7
x11 | x11 | (?<![a-z0-9-])(?:mit/)?x11 licen[cs]e | 0.8
cecill-2.1 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?[ ,-](?:version |v)?2\.1 | 0.85
cecill-b | cecill | (?<![a-z0-9])cecill-b(?![a-z0-9]) | 0.8
cecill-c | cecill | (?<![a-z0-9])cecill-c(?![a-z0-9]) | 0.8
gpl | classpath | (?:with the |with )?[\x22']?classpath[\x22']? exception | 0.6
mit | osi approved | license :: osi approved :: mit licen[cs]e | 0.95
bsd | osi approved | license :: osi approved :: bsd licen[cs]e | 0.95
apache-2.0 | osi approved | license :: osi approved :: apache software licen[cs]e | 0.9
gpl-2.0 | osi approved | license :: osi approved :: gnu general public license v2(?: or later)? \(gplv2\+?\) | 0.95
gpl-3.0 | osi approved | license :: osi approved :: gnu general public license v3(?: or later)? \(gplv3\+?\) | 0.95
lgpl-3.0 | osi approved | license :: osi approved :: gnu lesser general public license v3(?: or later)? \(lgplv3\+?\) | 0.95
agpl-3.0 | osi approved | license :: osi approved :: gnu affero general public license v3 | 0.95
mpl-2.0 | osi approved | license :: osi approved :: mozilla public license 2\.0 \(mpl 2\.0\) | 0.95
isc | osi approved | license :: osi approved :: isc license \(iscl\) | 0.95
psf-2.0 | osi approved | license :: osi approved :: python software foundation licen[cs]e | 0.95
unlicense | osi approved | license :: osi approved :: the unlicense \(unlicense\) | 0.95
public-domain | gemeinfrei | (?<![a-zäöüß])gemeinfrei(?![a-zäöüß]) | 0.7
public-domain | domaine public | (?:dans le|du) domaine public | 0.7
public-domain | dominio p | (?:al|en el|de) dominio público | 0.7
proprietary | rechte vorbehalten | alle rechte vorbehalten | 0.6
proprietary | tous droits | tous droits réservés | 0.6
proprietary | derechos reservados | todos los derechos reservados | 0.6
gpl | allgemeine | (?:gnu )?allgemeine öffentliche (?:gnu[- ])?lizenz | 0.7
gpl | licence publique | licence publique générale (?:de )?gnu | 0.8
gpl | licencia p | licencia pública general (?:de )?gnu | 0.8
mit | hiermit | hiermit wird unentgeltlich jeder person, die eine kopie der software | 0.9
mit | gratuitement | l'autorisation est par la présente accordée, gratuitement, à toute personne | 0.9
mit | por la presente | se concede permiso por la presente, de forma gratuita, a cualquier persona | 0.9
creative-commons | creative commons | creative[- ]commons[- ](?:lizenz|licencia)|licen(?:ce|cia) creative commons | 0.6
"""  # fmt: skip
#: Any rule's text holds one of these; many documents hold none.
GATES = (
    "licen", "right", "software", "domain", "creative", "cc", "gpl", "apache", "bsd", ".org", "wtfpl", "europa.eu", "redistribution",
    "released", "distributed", "available", "published", "provided", "covered", "proprietary", "unauthori", "prior",
    "lizenz", "gemeinfrei", "domaine public", "dominio p", "rechte vorbehalten", "tous droits", "reservados", "gratuitement", "por la presente",
    "unentgeltlich", "gfdl", "cecill", "same terms as", "classpath", "artistic-2", "artistic 2", "mpl", "epl-", "epl 1", "epl 2", "cddl", "eupl", "bsl-1", "bsl 1",
    "psf-2", "psf 2", "ofl-1", "ofl 1", "afl-3", "afl 3", "osl-3", "osl 3", "ms-pl", "ms pl", "odbl", "odc-by", "odc by", "mit-0", "mit 0", "unter",
)
#: Words and what stands between them; these classes are one or two look-ups a character.
WORD, SEP = r"[\p{Alnum}\x{80}-\x{10FFFF}]+", r"[\x00-\x7F&&[^\p{Alnum}]]+"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
KEPT = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,confidence:double>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Forms before the wordings in priority.
BEFORE = 3


def spaced(regex: str, between: str = r"\s") -> str:
    """The regex with any white space (or what else may stand between words) for its spaces, and letters beyond A-Z in both cases."""
    out, inside = "", False
    for x in regex.replace(" ?", "\x00"):
        inside = x == "[" or inside and x != "]"
        both = x if x.isascii() or len(x.upper()) > 1 or x == x.upper() else x + x.upper() if inside else f"[{x}{x.upper()}]"
        out += f"{between}*" if x == "\x00" else (r"\s" if inside else f"{between}+") if x == " " else both
    return out


def rules() -> list[dict]:
    """The ordered rules: rule number, priority, label, keywords (in each all words of one of some phrases), regex, confidence."""
    found = []
    for priority, (form, hint, confidence) in enumerate(FORMS):
        for line in LICENCES.strip().split("\n"):
            label, keyword, rest = (x.strip() for x in line.split(" | ", 2))
            name, _, url = rest.rpartition(" | ")
            if "{identifier}" in form and not IDENTIFIER.search(label):
                continue
            regex = spaced(form).replace("{label}", re.escape(label)).replace("{name}", f"(?:{spaced(name, NAMED)})").replace("{url}", url).replace("{identifier}", re.escape(label).replace(r"\-", "[- ]"))
            known = [re.match(r"[a-z0-9-]+", url)[0], label] if "{url}" in form else [label] if "{label}" in form else [label.replace("-", " ")] if "{identifier}" in form else keyword.split(",")
            found.append({"priority": priority + (priority >= BEFORE), "label": label, "keywords": [hint.split("|")] * bool(hint) + [known], "regex": regex, "confidence": confidence})
    for line in WORDINGS.strip().split("\n"):
        label, keyword, regex, confidence = (x.strip() for x in line.split(" | "))
        found.append({"priority": BEFORE, "label": label, "keywords": [[keyword]], "regex": spaced(regex), "confidence": float(confidence)})
    return [{"rule": i} | r for i, r in enumerate(sorted(found, key=lambda r: r["priority"]))]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(low: str, rule: dict) -> str:
    """SQL: whether the text holds the rule's keywords: of each list a phrase, all words of it somewhere."""
    held = lambda phrase: " AND ".join(f"contains({low}, {_quoted(w)})" for w in phrase.split()) or "true"
    return " AND ".join("(" + " OR ".join(f"({held(x)})" for x in phrases) + ")" for phrases in rule["keywords"])


def matched(low: str) -> Column:
    """array<struct<rule,whole,gaps>> of the rules that match a column of lower-cased text: all matches with the gaps before them.

    Each rule's regex is a literal of the plan, compiled once in a task, behind its keywords and a plain match; keywords that
    rules share are looked for once in a text."""
    low = f"`{low}`"
    live = (f"CASE WHEN {_gate(low, r)} AND {low} RLIKE {_quoted(r['regex'])} THEN named_struct('rule', {r['rule']}, 'whole', regexp_extract_all({low}, {_quoted(full := anchored(r['regex']))}, 0), 'gaps', regexp_extract_all({low}, {_quoted(full)}, 1)) END" for r in rules())
    return F.expr(f"array_compact(array({', '.join(live)}))")


def detections(matches: Column) -> Column:
    """array<struct<start,stop,priority,rule,label,confidence>> of what matched() gives, suppressed ones left out; by start."""
    levels = range(len(FORMS) + 1)
    known = F.expr("array(" + ",".join(f"named_struct('priority', {r['priority']}, 'label', {_quoted(r['label'])}, 'confidence', {r['confidence']}d)" for r in rules()) + ")")

    def told(x: Column) -> Column:
        r = F.get(known, x["rule"])
        return F.transform(spans_of(x["whole"], x["gaps"]), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), r["priority"].alias("priority"), x["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    found = F.flatten(F.transform(matches, told))
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in levels], F.expr(f"cast(array() as {KEPT})").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        stop, reach = -d["less"], F.lit(-1)
        for p in levels:  # the furthest end so far of detections of this or a better priority
            reach = F.when(d["priority"] == p, F.greatest(*[acc[f"m{i}"] for i in range(p + 1)], F.lit(-1))).otherwise(reach)
        one = F.struct(d["start"].alias("start"), stop.alias("stop"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        ends = [F.when(d["priority"] == p, F.greatest(acc[f"m{p}"], stop)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in levels]
        return F.struct(*ends, F.when(reach >= stop, acc["kept"]).otherwise(F.array_append(acc["kept"], one)).alias("kept"))

    return F.aggregate(F.array_sort(found), start, step)["kept"]


def detect(docs: DataFrame, text: str = "text", out: str = "detections") -> DataFrame:
    """docs and a column of its license detections."""
    low, live = f"{out}__low", f"{out}__live"  # columns of their own, so that each is computed once
    plain = docs.withColumn(low, F.lower(text))  # lower-cases more than A-Z, so it holds every gate that the text has
    gate = " OR ".join(f"contains(`{low}`, {_quoted(g)})" for g in GATES)
    lowered = plain.withColumn(low, F.when(F.expr(gate), F.translate(text, UPPER, LOWER)))
    found = lowered.withColumn(live, F.when(F.col(low).isNotNull(), matched(low)))
    return found.withColumn(out, F.when(F.col(live).isNull(), F.expr(f"cast(array() as {KEPT})")).otherwise(detections(F.col(live)))).drop(low, live)


def phrase_places(norm: Column, n_words: Column) -> Column:
    """array<struct<label,n,first,last>> of the base phrases in a text of words with a space before, between and after
    them: the number of places and the smallest and largest start in words."""
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    each = []
    for phrase, label in PHRASES.items():
        parts = F.split(norm, f" {phrase}(?= )", -1)
        each.append(F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), spaces(F.get(parts, F.lit(0))).cast("long").alias("first"), (n_words - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())).cast("long").alias("last")))
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections of each row."""
    given = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), given.alias("text"))
    base = base.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long"))
    starts, seconds = ("|".join(dict.fromkeys(p.split()[i] for p in PHRASES)) for i in (0, 1))
    low = F.lower("text")  # of the phrases each holds one of two words
    base = base.withColumn("low", F.when(F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc")), F.translate("text", UPPER, LOWER)))
    base = base.withColumn("norm", F.when(F.col("low").rlike(rf"(?:{starts}){SEP}(?:{seconds})"), F.concat(F.lit(" "), F.trim(F.regexp_replace("low", SEP, " ")), F.lit(" "))).otherwise(" "))
    base = base.withColumn("places", F.when(F.col("norm") == " ", F.expr("cast(array() as array<struct<label:string,n:bigint,first:bigint,last:bigint>>)")).otherwise(phrase_places(F.col("norm"), F.col("n_words"))))
    found = detect(base)
    base_labels = F.transform("places", lambda p: p["label"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("key").alias(key), "n_words", F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        join(base_labels).alias("base_labels"), join(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.6).otherwise(0.0)).alias("score"),
        "detections",
    )
