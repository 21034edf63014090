"""License scans by ordered signature rules.

A text is cut into lower-case words once; rules are regular expressions over
the words joined by single spaces. One pass of a keyword automaton finds which
keywords stand in the text, and only rules whose keyword is there are tried. A
detection is an interval of words. Detections are ordered by priority, then
length; one that lies inside an interval of higher or equal priority is
suppressed. Base phrases are counted apart from that and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: label | how the name is written, as a regular expression over words | keyword.
#: Each name gives one rule for each way of granting (``GRANTS``).
NAMES = """
apache-2.0 | apache (?:software )?license(?: version)? 2(?: 0)? | apache
apache-1.1 | apache (?:software )?license(?: version)? 1 1 | apache
apache-1.0 | apache (?:software )?license(?: version)? 1 0 | apache
agpl-3.0 | (?:gnu )?affero general public license(?:(?: version)? v?3(?: 0)?)? | affero
lgpl-2.0 | (?:gnu )?library general public license(?:(?: version)? v?2(?: 0)?)? | library general
lgpl-2.1 | (?:gnu )?lesser general public license(?: version)? v?2(?: 1)? | lesser general
lgpl-3.0 | (?:gnu )?lesser general public license(?: version)? v?3(?: 0)? | lesser general
gpl-1.0 | (?:gnu )?general public license(?: version)? v?1(?: 0)? | general public
gpl-2.0 | (?:gnu )?general public license(?: version)? v?2(?: 0)? | general public
gpl-3.0 | (?:gnu )?general public license(?: version)? v?3(?: 0)? | general public
gfdl-1.3 | (?:gnu )?free documentation license(?:(?: version)? v?1 3)? | free documentation
mit | (?:the )?mit license | mit
mit-0 | mit no attribution(?: license)? | no attribution
bsd-2-clause | (?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause)(?: license)? | bsd
bsd-3-clause | (?:new bsd|modified bsd|3 clause bsd|bsd 3 clause)(?: license)? | bsd
bsd-4-clause | (?:original bsd|4 clause bsd|bsd 4 clause)(?: license)? | bsd
0bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: license)? | bsd
isc | isc license | isc
mpl-1.1 | mozilla public license(?: version)? v?1 1 | mozilla
mpl-2.0 | mozilla public license(?: version)? v?2(?: 0)? | mozilla
epl-1.0 | eclipse public license(?: version)? v?1(?: 0)? | eclipse
epl-2.0 | eclipse public license(?: version)? v?2(?: 0)? | eclipse
edl-1.0 | eclipse distribution license(?: version)? v?1(?: 0)? | eclipse
cddl-1.0 | common development and distribution license(?: version)?(?: v?1(?: 0)?)? | common development
cpl-1.0 | common public license(?: version)?(?: v?1(?: 0)?)? | common public
eupl-1.1 | european union public licen[cs]e(?: version)? v?1 1 | european union
eupl-1.2 | european union public licen[cs]e(?: version)? v?1 2 | european union
artistic-1.0 | artistic license(?: version)? 1(?: 0)? | artistic
artistic-2.0 | artistic license(?: version)? 2(?: 0)? | artistic
bsl-1.0 | boost software license(?:(?: version)? 1(?: 0)?)? | boost
busl-1.1 | business source license(?:(?: version)? 1 1)? | business source
zlib | zlib license | zlib
libpng | libpng license | libpng
unlicense | (?:the )?unlicense | unlicense
wtfpl | (?:wtfpl|do what the fuck you want to public license) | wtf|what the fuck
ofl-1.1 | sil open font license(?:(?: version)? 1 1)? | open font
psf-2.0 | (?:python software foundation|psf) license(?:(?: version)? 2(?: 0)?)? | license
php-3.01 | php license(?:(?: version)? 3 01)? | php
ruby | ruby license | ruby
openssl | openssl license | openssl
postgresql | postgresql license | postgresql
ncsa | (?:university of illinois )?ncsa open source license | ncsa
ms-pl | microsoft public license | microsoft
ms-rl | microsoft reciprocal license | microsoft
osl-3.0 | open software license(?:(?: version)? v?3(?: 0)?)? | open software
afl-3.0 | academic free license(?:(?: version)? v?3(?: 0)?)? | academic free
apsl-2.0 | apple public source license(?:(?: version)? 2(?: 0)?)? | apple
cecill-2.1 | cecill(?: free software)? license(?: agreement)?(?:(?: version)? 2 1)? | cecill
elastic-2.0 | elastic license(?:(?: version)? 2(?: 0)?)? | elastic
sspl-1.0 | server side public license(?:(?: version)? v?1(?: 0)?)? | server side
odbl-1.0 | (?:open data commons )?open database license(?:(?: version)? v?1 0)? | open database
odc-by-1.0 | open data commons attribution license | open data commons
pddl-1.0 | public domain dedication and license | public domain
cdla-permissive-2.0 | community data license agreement permissive(?: version)?(?: 2 0)? | community data
cc-by-sa-4.0 | (?:cc by sa|creative commons attribution share ?alike)(?: 4 0)?(?: international)? | sa|alike
cc-by-nc-4.0 | (?:cc by nc|creative commons attribution non ?commercial)(?: 4 0)?(?: international)? | nc|commercial
cc-by-nd-4.0 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: 4 0)?(?: international)? | nd|deriv
cc-by-nc-sa-4.0 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: 4 0)?(?: international)? | nc|commercial
cc-by-nc-nd-4.0 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: 4 0)?(?: international)? | nc|commercial
cc-by-4.0 | (?:cc by|creative commons attribution(?: license)?) 4 0(?: international)? | cc by|creative
cc-by-3.0 | (?:cc by|creative commons attribution(?: license)?) 3 0(?: unported)? | cc by|creative
cc-by-2.0 | (?:cc by|creative commons attribution(?: license)?) 2 0(?: generic)? | cc by|creative
cc0-1.0 | (?:cc0|creative commons zero)(?: 1 0)?(?: universal)? | cc0|creative
""".strip()

#: (prefix, priority, confidence) of a granting sentence around a license name.
GRANTS = (
    (r"spdx license identifier ", 95, 1.0),
    (r"(?:is |are )?(?:licensed|released|distributed|published|available|made available|provided|covered) (?:to you )?(?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? ", 80, 0.95),
    (r"(?:under|subject to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? ", 70, 0.9),
    (r"", 50, 0.75),
)

#: label | priority | confidence | keyword | regular expression over words: sentences of the license texts and notices.
SENTENCES = """
mit | 90 | 1.0 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 60 | 0.8 | warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to
isc | 90 | 1.0 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-4-clause | 92 | 1.0 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | 91 | 1.0 | endorse or promote | neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | 85 | 0.9 | source and binary | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | 90 | 1.0 | apache org licenses | apache org licenses license 2 0
apache-2.0 | 60 | 0.9 | except in compliance | you may not use this file except in compliance with the license
gpl-2.0-or-later | 93 | 1.0 | general public | general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | 93 | 1.0 | general public | general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2.1-or-later | 94 | 1.0 | lesser general | lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
gpl-notice | 60 | 0.8 | general public | you should have received a copy of the gnu (?:lesser |affero )?general public license
gpl-notice | 55 | 0.8 | free software | this program is free software you can redistribute it and or modify
gpl-family | 20 | 0.6 | general public | (?:gnu )?general public license
lgpl-family | 25 | 0.6 | lesser general | (?:gnu )?lesser general public license
mpl-2.0 | 90 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
epl-2.0 | 90 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
zlib | 90 | 1.0 | altered source | altered source versions must be plainly marked as such
bsl-1.0 | 90 | 1.0 | permission is hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | 90 | 1.0 | public domain | this is free and unencumbered software released into the public domain
wtfpl | 90 | 1.0 | what the fuck | you just do what the fuck you want to
ofl-1.1 | 90 | 1.0 | reserved font name | with reserved font name
cc-by-any | 30 | 0.7 | creative commons | creative commons attribution
cc-any | 20 | 0.5 | creative commons | creative commons(?: license)?
cc-by-any | 20 | 0.6 | cc by | cc by
cc-by-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | 90 | 1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 40 | 0.7 | public domain | (?:is |are |been )?(?:released|placed|dedicated)? ?(?:in|into|to) the public domain
public-domain | 20 | 0.5 | public domain | public domain
copyright-notice | 35 | 0.6 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
all-rights-reserved | 40 | 0.7 | rights reserved | all rights reserved
some-rights-reserved | 40 | 0.7 | rights reserved | some rights reserved
no-rights-reserved | 40 | 0.7 | rights reserved | no rights reserved
proprietary | 60 | 0.8 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 60 | 0.8 | prohibited | unauthorized (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))? (?:of this file )?(?:\\S+ ){0,6}is (?:strictly )?prohibited
proprietary | 50 | 0.7 | written permission | without (?:the )?(?:express |prior )*written permission
non-commercial | 50 | 0.7 | commercial | (?:for )?(?:personal|educational|academic|research)?(?: and| or)? ?non ?commercial (?:use|purposes)(?: only)?
no-redistribution | 50 | 0.7 | not be | (?:may|must) not be (?:reproduced|redistributed|republished|copied)
permissive-notice | 30 | 0.5 | provided that | provided that the (?:above|original) copyright notice
warranty-disclaimer | 30 | 0.5 | as is | provided as is (?:without|with no) (?:express or implied )?warrant(?:y|ies)
fair-use | 30 | 0.5 | fair use | (?:constitutes |under )?fair use
dmca | 30 | 0.5 | dmca|digital millennium | (?:dmca|digital millennium copyright act)
tdm-reservation | 60 | 0.8 | text and data mining|tdm | (?:text and data mining|tdm) (?:rights |is |are )?(?:reserved|prohibited|not permitted)
no-ai-training | 60 | 0.8 | not be used | (?:may not|must not|not) be used (?:for|to) (?:the )?(?:training|train) (?:of )?(?:ai|artificial intelligence|machine learning)
mit | 85 | 0.9 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 55 | 0.8 | in no event shall | in no event shall the authors or copyright holders be liable for any claim damages or other liability
bsd-2-clause | 60 | 0.8 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 60 | 0.8 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-family | 50 | 0.7 | contributors as is | this software is provided by the (?:copyright holders|regents) and contributors as is
bsd-family | 25 | 0.5 | bsd | (?:the )?bsd (?:style )?licen[cs]e
isc | 55 | 0.8 | author disclaims | the (?:software is provided as is and the )?author disclaims all warranties with regard to this software
apache-2.0 | 70 | 0.9 | distributed on an | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 | 65 | 0.9 | permissions and limitations | see the license for the specific language governing permissions and limitations under the license
apache-family | 25 | 0.5 | apache | apache (?:software )?licen[cs]e
gpl-notice | 58 | 0.8 | without any warranty | distributed in the hope that it will be useful but without any warranty
gpl-notice | 58 | 0.8 | free software foundation | write to the free software foundation inc
gpl-notice | 58 | 0.8 | gnu org licenses | (?:see )?(?:https? )?(?:www )?gnu org licenses
gpl-2.0-only | 93 | 1.0 | version 2 | general public license version 2 only
gpl-3.0-only | 93 | 1.0 | version 3 | general public license version 3 only
gpl-exception | 70 | 0.8 | ing exception|path exception | (?:gnu )?(?:classpath|linking) exception
agpl-3.0-or-later | 94 | 1.0 | affero | affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-notice | 60 | 0.8 | interacting with it remotely | all users interacting with it remotely through a computer network
lgpl-notice | 60 | 0.8 | work that uses the library | work that uses the library
gfdl-notice | 80 | 0.9 | documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-no-invariant | 75 | 0.9 | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | 85 | 0.9 | mozilla org | mozilla org mpl 2 0
mpl-1.1 | 88 | 0.9 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-exhibit-b | 85 | 0.9 | incompatible with secondary | this source code form is incompatible with secondary licenses
epl-2.0 | 88 | 0.9 | eclipse org | eclipse org legal epl (?:2 0|v20)
cddl-1.0 | 85 | 0.9 | common development | the contents of this file are subject to the terms of the common development and distribution license
artistic-notice | 60 | 0.8 | as perl | under the same terms as perl(?: itself)?
python-notice | 60 | 0.8 | as python | under the same terms as python(?: itself)?
boost-url | 88 | 1.0 | boost org | boost org license 1 0
zlib | 70 | 0.9 | misrepresented | the origin of this software must not be misrepresented
zlib | 60 | 0.8 | altered from any source | this notice may not be removed or altered from any source distribution
openssl | 85 | 0.9 | openssl | this product includes software developed by the openssl project
ssleay | 85 | 0.9 | eric young | this product includes cryptographic software written by eric young
unlicense | 80 | 0.9 | unlicense org | unlicense org
unlicense | 80 | 0.9 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | 80 | 0.9 | waived all copyright | (?:has |have )?waived all copyright and related or neighboring rights
cc-by-sa-any | 35 | 0.7 | alike | creative commons attribution share ?alike
cc-by-nc-any | 35 | 0.7 | commercial | creative commons attribution non ?commercial
cc-by-nd-any | 35 | 0.7 | deriv | creative commons attribution no ?deriv(?:ative)?s
cc-notice | 50 | 0.7 | creative commons | except where otherwise noted (?:\\S+ ){0,8}creative commons
cc-by-2.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-2.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by sa 2 0
cc-by-nc-3.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-sa-3.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-3.0 | 90 | 1.0 | creativecommons | creativecommons org licenses by nc nd 3 0
cc-pdm-1.0 | 90 | 1.0 | creativecommons | creativecommons org publicdomain mark 1 0
odbl-1.0 | 88 | 1.0 | opendatacommons | opendatacommons org licenses odbl
odc-by-1.0 | 88 | 1.0 | opendatacommons | opendatacommons org licenses by
pddl-1.0 | 88 | 1.0 | opendatacommons | opendatacommons org licenses pddl
osm-attribution | 60 | 0.8 | openstreetmap | openstreetmap contributors
ogl-uk-3.0 | 80 | 0.9 | open government | (?:contains public sector information licensed under the )?open government licen[cs]e(?: v3 0)?
us-government-work | 60 | 0.8 | government | (?:a )?work of the (?:united states|u s|us) government
crown-copyright | 60 | 0.8 | crown copyright | crown copyright
json | 85 | 0.9 | good not evil | shall be used for good not evil
beerware | 85 | 0.9 | beer | beer ?ware licen[cs]e|you can buy me a beer in return
hippocratic | 80 | 0.9 | hippocratic | hippocratic licen[cs]e
commons-clause | 80 | 0.9 | commons clause | commons clause
openrail | 80 | 0.9 | rail|responsible ai | (?:creativeml )?open ?rail(?: m| d| s)? licen[cs]e|responsible ai licen[cs]e
llama-community | 80 | 0.9 | llama | llama (?:2 |3 )?community licen[cs]e
research-only | 55 | 0.7 | research | (?:for )?(?:academic |scientific )?research (?:use|purposes) only
personal-use-only | 55 | 0.7 | personal | (?:for )?personal use only
evaluation-only | 55 | 0.7 | evaluation | (?:for )?evaluation (?:use|purposes) only
trial-version | 40 | 0.6 | trial version | trial version
eula | 50 | 0.7 | end user | end user licen[cs]e agreement
terms-of-use | 40 | 0.6 | terms of | terms of (?:use|service) apply
trademark-notice | 35 | 0.6 | trademark | (?:is a |are )(?:registered )?trademarks? of
patent-grant | 50 | 0.7 | patent | royalty free irrevocable (?:\\S+ ){0,4}patent licen[cs]e
patent-pending | 35 | 0.6 | patent pending | patent pending
confidential | 50 | 0.7 | confidential | (?:strictly |company )confidential|confidential information of
trade-secret | 50 | 0.7 | trade secret | trade secrets? of
internal-use-only | 55 | 0.7 | internal use | (?:for )?internal use only
no-derivatives | 50 | 0.7 | derivative | no derivative works|may not create derivative works
no-scraping | 55 | 0.7 | scrap|crawl|automated means | (?:may|must) not (?:scrape|crawl)|scraping is prohibited|access (?:\\S+ ){0,4}by automated means
no-commercial-use | 50 | 0.7 | commercial use | no commercial use|commercial use (?:is )?(?:prohibited|not permitted|not allowed|forbidden)
reprint-permission | 45 | 0.6 | permission | (?:reprinted|reproduced|used) (?:by|with) permission
republish-permission | 45 | 0.6 | republish|reprint | (?:to )?(?:republish|reprint) (?:\\S+ ){0,4}(?:contact|permission)
attribution-required | 45 | 0.6 | attribution | attribution (?:is )?required
copyright-holder | 30 | 0.5 | copyright | copyright (?:the )?(?:author|authors|owner|owners|holder|holders)
copyright-mark | 30 | 0.5 | copr | copr (?:19|20)[0-9]{2}
moral-rights | 45 | 0.6 | moral right | moral rights? of the author
public-domain | 45 | 0.7 | copyright | no (?:known )?copyright(?: restrictions)?
gemeinfrei | 45 | 0.7 | gemeinfrei | gemeinfrei
reserved-de | 45 | 0.7 | rechte vorbehalten | alle rechte vorbehalten
reserved-fr | 45 | 0.7 | droits r | tous droits réservés
reserved-es | 45 | 0.7 | derechos reservados | todos los derechos reservados
""".strip()


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


class Hit(NamedTuple):
    label: str
    first: int
    last: int
    priority: int
    confidence: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, in order of priority."""
    out = []
    for line in NAMES.splitlines():
        label, name, keyword = (x.strip() for x in line.split(" | "))
        spdx = "(?:" + name + "|" + label.replace(".", " ").replace("-", " ") + "(?: only)?)"
        for prefix, priority, confidence in GRANTS:
            body = spdx if "spdx" in prefix else name
            keys = ("spdx",) if "spdx" in prefix else tuple(keyword.split("|"))
            out.append(Rule(label, priority + label.count("-"), confidence, keys, re.compile(f"(?<= ){prefix}(?:{body})(?= )")))
    for line in SENTENCES.splitlines():
        label, priority, confidence, keyword, body = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, int(priority), float(confidence), tuple(keyword.split("|")), re.compile(f"(?<= )(?:{body.replace(chr(92) * 2, chr(92))})(?= )")))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    table: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            table.setdefault(k, []).append(i)
    found = ahocorasick.Automaton()
    for k, numbers in table.items():
        found.add_word(k, numbers)
    found.make_automaton()
    return found


def suppress(found: list[Hit]) -> list[Hit]:
    """Detections that no other one of higher or equal priority contains, in order of place.

    One sweep for each priority, from the highest: what is kept so far answers,
    by bisection, how far a detection that begins no later reaches.
    """
    kept: list[Hit] = []
    starts: list[int] = []
    reach: list[int] = []
    for _, level in groupby(sorted(found, key=lambda h: (-h.priority, h.first, -h.last, h.label)), key=lambda h: h.priority):
        end, new = -1, []
        for h in level:
            k = bisect_right(starts, h.first)
            if h.last > max(end, reach[k - 1] if k else -1):
                new.append(h)
                end = h.last
        if new:
            kept += new
            kept.sort(key=lambda h: (h.first, h.last, h.label))
            starts, reach = [h.first for h in kept], list(accumulate((h.last for h in kept), max))
    return kept


def words_of(text: str | None) -> tuple[int, str]:
    """The number of words, and the words with single spaces between and around them."""
    words = (text or "").encode().translate(_TABLE).split()
    return len(words), " " + b" ".join(words).decode() + " "


def detect(joined: str, gated: bool = True) -> list[Hit]:
    """What the signature rules find, after suppression; places are word numbers from 0.

    ``gated`` tries only rules of which a keyword stands in the text.
    """
    candidates = sorted({i for _, numbers in _automaton().iter(joined) for i in numbers}) if gated else range(len(rules()))
    spaces: list[int] | None = None
    found = []
    for i in candidates:
        r = rules()[i]
        for m in r.pattern.finditer(joined):
            if spaces is None:
                spaces = [k for k, c in enumerate(joined) if c == " "]
            first = bisect_left(spaces, m.start()) - 1
            found.append(Hit(r.label, first, first + m[0].strip().count(" "), r.priority, r.confidence))
    return suppress(found)


def base_places(joined: str) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase, in order of phrases."""
    out = []
    for phrase, label in BASE.items():
        words = upto = 0
        at = joined.find(f" {phrase} ")
        while at >= 0:
            words += joined.count(" ", upto, at)  # counts on from the place before
            upto = at
            out.append((words, label))
            at = joined.find(f" {phrase} ", at + 1)
    return out


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of a whole text."""
    n, joined = words_of(text)
    places = base_places(joined)
    starts, base = [k for k, _ in places], {label for _, label in places}
    hits = detect(joined)
    labels = base | {h.label for h in hits}
    score = max([0.5 * bool(base), *(h.confidence for h in hits)])
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), [h._asdict() for h in hits]


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    One row for every row of ``docs``, repeated rows and rows without an id
    included; an empty table gives none. A null or empty text has no words, no
    labels and score 0. Texts are read whole, in time linear in their length
    (but for sorting detections). ``detections`` is an array of (label, first, last,
    priority, confidence), places in words. Other columns are not read.
    """
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(scan, batch.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    return docs.select("doc_id", "text").mapInArrow(run, schema + "detections array<struct<label: string, first: bigint, last: bigint, priority: int, confidence: double>>")
