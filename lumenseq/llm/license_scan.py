"""License detection by ordered signature rules.

A text becomes lower-case words joined by single spaces. Hand-written signatures (notices, headers, clauses,
expressions, version-bound wordings; some two hundred) and some three hundred patterns of license names in hand-written contexts (a grant,
a title, an identifier tag, an address, ...) recognise licenses in it. A rule only runs if its keywords are all among the
text's words. A detection inside the interval of one with a higher priority, or of an equal one
that is longer, is suppressed, so that "gnu lesser general public license version 3" is not also a
general public license. Detections that overlap in part only name different things and stay.

Some names are common words ("mit" in German, "ruby", "vim"), so a field like "License: MIT" only counts if the text itself has a
sign of one between "license" and the name (a colon, an equals sign, a bracket, ...), or the name alone on its line.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

# Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, the license's name as words (a regular expression), its address or tag as
# words, a keyword that its name always has, and its specificity.
NAMES = (
    ("mit", r"(?:mit|expat)(?: x11)?", r"mit", "mit|expat", 2),
    ("x11", r"x11", r"x11", "x11", 1),
    ("isc", r"isc", r"isc", "isc", 1),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", r"0bsd", "bsd|0bsd", 4),
    ("bsd", r"bsd(?: style)?", r"bsd", "bsd", 1),
    ("bsd-2-clause", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)", r"bsd 2 clause", "bsd|freebsd", 3),
    ("bsd-3-clause", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause", "bsd", 3),
    ("bsd-4-clause", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", r"bsd 4 clause", "bsd", 3),
    ("apache-1.1", r"apache(?: software)? license(?: version)? v? ?1 1", r"apache 1 1", "apache", 4),
    ("apache-2", r"apache(?: software)?(?: public)? license(?: version)? v? ?2(?: 0)?", r"apache 2(?: 0)?", "apache", 4),
    ("apache", r"apache(?: software)?(?: public)?", r"apache", "apache", 1),
    ("gpl-2", r"(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2(?: 0)?", r"gpl ?v?2(?: 0)?(?: only| or later)?", "gpl|general|gplv2|gpl2", 4),
    ("gpl-3", r"(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?", r"gpl ?v?3(?: 0)?(?: only| or later)?", "gpl|general|gplv3|gpl3", 4),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", r"gpl", "gpl|general", 1),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl) (?:version |v ?)?2(?: 1)?", r"lgpl ?v?2 1(?: only| or later)?", "lgpl|lesser|library|lgplv2", 6),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v ?)?3(?: 0)?", r"lgpl ?v?3(?: 0)?(?: only| or later)?", "lgpl|lesser|lgplv3", 6),
    ("lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", r"lgpl", "lgpl|lesser|library", 5),
    ("agpl-3", r"(?:gnu )?(?:affero general public license|agpl) (?:version |v ?)?3(?: 0)?", r"agpl ?v?3(?: 0)?(?: only| or later)?", "agpl|affero|agplv3", 6),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", r"agpl", "agpl|affero", 5),
    ("gfdl", r"(?:gnu )?(?:free documentation|gfdl|fdl)", r"gfdl(?: 1 3)?", "gfdl|documentation|fdl", 3),
    ("mpl-1.1", r"(?:mozilla public license|mpl) (?:version |v ?)?1 1", r"mpl 1 1", "mozilla|mpl", 4),
    ("mpl-2", r"(?:mozilla public license|mpl) (?:version |v ?)?2(?: 0)?", r"mpl 2 0", "mozilla|mpl", 4),
    ("mpl", r"(?:mozilla public|mpl)", r"mpl", "mozilla|mpl", 1),
    ("epl-1", r"(?:eclipse public license|epl) (?:version |v ?)?1(?: 0)?", r"epl 1 0", "eclipse|epl", 4),
    ("epl-2", r"(?:eclipse public license|epl) (?:version |v ?)?2(?: 0)?", r"epl 2 0", "eclipse|epl", 4),
    ("cddl", r"(?:common development and distribution|cddl)", r"cddl 1 [01]", "cddl|development", 3),
    ("cpl", r"common public", r"cpl 1 0", "common|cpl", 2),
    ("eupl", r"(?:european union public|eupl)", r"eupl 1 [12]", "eupl|european", 3),
    ("artistic", r"(?:perl )?artistic", r"artistic [12] 0", "artistic", 2),
    ("zlib", r"zlib(?: libpng)?", r"zlib", "zlib", 2),
    ("bsl-1", r"boost software", r"bsl 1 0", "boost|bsl", 3),
    ("unlicense", r"unlicense", r"unlicense", "unlicense", 3),
    ("wtfpl", r"(?:do what the fuck you want to public|wtfpl)", r"wtfpl", "wtfpl|fuck", 3),
    ("ofl", r"(?:sil )?(?:open font|ofl)", r"ofl 1 1", "ofl|font", 3),
    ("odbl", r"(?:open database|odbl)", r"odbl 1 0", "odbl|database", 3),
    ("odc-by", r"open data commons attribution", r"odc by 1 0", "odc|commons", 3),
    ("ms-pl", r"microsoft public", r"ms pl", "microsoft|ms", 3),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", "microsoft|ms", 3),
    ("python-2", r"(?:python software foundation|psf)", r"psf 2 0", "python|psf", 3),
    ("php-3", r"php", r"php 3 01?", "php", 2),
    ("ruby", r"ruby", r"ruby", "ruby", 2),
    ("openssl", r"openssl", r"openssl", "openssl", 3),
    ("postgresql", r"postgresql", r"postgresql", "postgresql", 3),
    ("vim", r"vim", r"vim", "vim", 2),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", r"cc0 1 0", "cc0|cc|commons", 6),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no derivatives|noderivs|noderivatives)", r"cc by nc nd(?: [1-4] [05])?", "cc|commons", 8),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", r"cc by nc sa(?: [1-4] [05])?", "cc|commons", 8),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)", r"cc by nc(?: [1-4] [05])?", "cc|commons", 7),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no derivatives|noderivs|noderivatives)", r"cc by nd(?: [1-4] [05])?", "cc|commons", 7),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)", r"cc by sa(?: [1-4] [05])?", "cc|commons", 7),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)", r"cc by(?: [1-4] [05])?", "cc|commons", 6),
    ("public-domain", r"public domain", r"public domain", "domain", 1),
)

LICENSE = r"(?:licen[sc]e|licen[sc]es)"
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|shared|offered)"
TERMS = r"(?:(?:the )?terms(?: and conditions)? of )?(?:the |an? )?"
# Contexts of a name, with the words that they need, a priority and a score.
CONTEXTS = (
    ("grant", rf"{GRANT} (?:\w+ ){{0,2}}under {TERMS}{{name}}(?: {LICENSE})?", "under", 50, 1.0),
    ("under", rf"under {TERMS}{{name}} {LICENSE}", "under", 45, 0.95),
    ("title", rf"(?:the )?{{name}} (?:international |public )?{LICENSE}(?: (?:version|v) ?\d+(?: \d+)?)?", "license|licence|licenses", 40, 0.9),
    ("tag", r"(?:spdx )?license identifier {tag}", "identifier", 60, 1.0),
    ("field", rf"{LICENSE} (?:type |name )?(?:is )?(?P<field>{{tag}})(?= |$)", "license|licence|licenses", 30, 0.8),
    ("address", r"(?:opensource org licenses|creativecommons org licenses|www gnu org licenses|www apache org licenses|spdx org licenses) {tag}", "org", 55, 0.95),
)
#: Products whose name beside "license" may mean any license; the title alone names theirs only with a version.
PRODUCTS = frozenset(["php-3", "ruby", "vim", "postgresql", "openssl", "python-2"])
#: Names that say "license" themselves or need no such word to be plain.
PLAIN = frozenset(["apache-1.1", "apache-2", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-1.1", "mpl-2", "epl-1", "epl-2", "cc0", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa"])
#: Signatures of notices, headers, clauses and expressions as words: label, keyword, priority, score, pattern.
SIGNATURES = r"""
mit | hereby | 20 | 0.7 | permission is hereby granted free of charge to any person obtaining a copy
mit | notice | 18 | 0.6 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merchantability | 12 | 0.5 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | mit | 35 | 0.85 | (?:this|the) (?:project|software|code|library|package|work|file|program) is (?:mit|mit licensed)
mit | mit | 33 | 0.8 | mit licensed
mit | mit | 58 | 1.0 | license (?P<field>mit)
mit | mit | 34 | 0.8 | (?:see|read) (?:the )?license (?:file )?for (?:the )?mit (?:terms|text|details)
mit-0 | attribution | 48 | 0.9 | mit no attribution(?: license)?
mit-0 | mit | 60 | 1.0 | spdx license identifier mit 0
isc | fee | 25 | 0.8 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | 18 | 0.6 | the author disclaims all warranties with regard to this software including all implied warranties
isc | isc | 58 | 1.0 | license (?P<field>isc)
bsd | redistribution | 20 | 0.7 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 19 | 0.6 | redistributions of source code must retain the above copyright notice this list of conditions
bsd | redistributions | 19 | 0.6 | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | holders | 15 | 0.5 | this software is provided by the copyright holders and contributors as is
bsd | bsd | 34 | 0.8 | bsd (?:style )?licensed
bsd | bsd | 35 | 0.8 | (?:use of this source code|this source code) is governed by a bsd style license
bsd-3-clause | endorse | 28 | 0.85 | neither the name of (?:the )?(?:\w+ ){1,8}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd-4-clause | advertising | 29 | 0.9 | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-2-clause | bsd | 59 | 1.0 | license (?P<field>bsd 2 clause)
bsd-3-clause | bsd | 59 | 1.0 | license (?P<field>bsd 3 clause)
bsd-4-clause | bsd | 59 | 1.0 | license (?P<field>bsd 4 clause)
0bsd | 0bsd | 59 | 1.0 | license (?P<field>0bsd)
apache-2 | apache | 52 | 1.0 | licensed under the apache license version 2(?: 0)?
apache-2 | compliance | 30 | 0.8 | you may not use this file except in compliance with the license
apache-2 | apache | 51 | 1.0 | you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2 | agreed | 24 | 0.7 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | grants | 22 | 0.7 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | apache | 36 | 0.85 | apache 2(?: 0)? licensed
apache-2 | apache | 33 | 0.8 | (?:asl|al) 2 0 apache
apache-2 | apache | 59 | 1.0 | license (?P<field>apache 2 0)
apache-1.1 | apache | 42 | 0.9 | this product includes software developed by the apache software foundation
gpl-2 | gnu | 54 | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2 | gnu | 53 | 1.0 | gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3 | gnu | 54 | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3 | gnu | 53 | 1.0 | gnu general public license version 3 (?:only )?as published by the free software foundation
gpl | redistribute | 26 | 0.7 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | 22 | 0.6 | this program is distributed in the hope that it will be useful but without any warranty
gpl | gnu | 24 | 0.7 | you should have received a copy of the gnu general public license along with this program
gpl | verbatim | 16 | 0.5 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2 | gplv2 | 44 | 0.95 | (?:gnu )?gplv2(?: only| or later)?
gpl-3 | gplv3 | 44 | 0.95 | (?:gnu )?gplv3(?: only| or later)?
gpl-2 | gpl | 61 | 1.0 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | gpl | 61 | 1.0 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | gpl | 59 | 1.0 | license (?P<field>gpl 2(?: 0)?)
gpl-3 | gpl | 59 | 1.0 | license (?P<field>gpl 3(?: 0)?)
gpl-2-classpath | classpath | 64 | 1.0 | (?:gpl|gnu general public license) (?:version )?2(?: 0)?(?: only)? with (?:the )?classpath exception(?: 2 0)?
gpl-2-classpath | linking | 47 | 0.9 | linking this library statically or dynamically with other modules is making a combined work based on this library
lgpl-2.1 | lesser | 56 | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3 | lesser | 56 | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2 | library | 56 | 1.0 | gnu library general public license as published by the free software foundation either version 2 of the license
lgpl | lesser | 28 | 0.7 | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | library | 23 | 0.6 | this library is distributed in the hope that it will be useful but without any warranty
lgpl-2.1 | lgplv2 | 46 | 0.95 | lgplv2 1(?: only| or later)?
lgpl-3 | lgplv3 | 46 | 0.95 | lgplv3(?: only| or later)?
agpl-3 | affero | 57 | 1.0 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3 | affero | 30 | 0.75 | under the terms of the gnu affero general public license
agpl-3 | agplv3 | 46 | 0.95 | agplv3(?: only| or later)?
agpl-3 | remotely | 27 | 0.8 | all users interacting with it remotely through a computer network
mpl-2 | mozilla | 57 | 1.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mpl | 50 | 1.0 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | 55 | 1.0 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | mpl | 59 | 1.0 | license (?P<field>mpl 2 0)
epl-1 | eclipse | 54 | 1.0 | (?:made available|distributed) under the terms of the eclipse public license v ?1 0
epl-2 | eclipse | 54 | 1.0 | (?:made available|distributed) under the terms of the eclipse public license (?:v ?)?2 0
cddl | development | 50 | 0.95 | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | 48 | 0.9 | cddl 1 [01]
cpl | common | 46 | 0.9 | common public license version 1 0
ipl | ibm | 46 | 0.9 | ibm public license version 1 0
eupl | eupl | 54 | 1.0 | licensed under the eupl(?: version)?(?: 1 [012])?
artistic | artistic | 47 | 0.9 | the artistic license(?: 2 0| version 2 0)?
artistic | perl | 46 | 0.9 | (?:free software you can redistribute it and or modify it )?under the same terms as perl(?: itself)?
zlib | altered | 24 | 0.8 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | 24 | 0.8 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | warranty | 20 | 0.7 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1 | boost | 56 | 1.0 | distributed under the boost software license version 1 0
unlicense | unencumbered | 65 | 1.0 | this is free and unencumbered software released into the public domain
unlicense | sell | 40 | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck | 46 | 0.95 | do what the fuck you want to(?: public license)?
cc0 | waived | 50 | 0.95 | (?:has|have) waived all copyright and related or neighboring rights to
cc0 | cc0 | 47 | 0.9 | (?:released|dedicated|published|placed) (?:under|into|to|using) (?:the )?(?:creative commons )?cc0
cc-by | commons | 56 | 0.95 | this work is licensed under a creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)? license
cc-by-sa | commons | 63 | 1.0 | this work is licensed under a creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)? license
cc-by-nd | commons | 63 | 1.0 | this work is licensed under a creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?(?: international| unported)? license
cc-by-nc | commons | 62 | 1.0 | this work is licensed under a creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)? license
cc-by-nc-sa | commons | 66 | 1.0 | this work is licensed under a creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)? license
cc-by-nc-nd | commons | 66 | 1.0 | this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?(?: international| unported)? license
cc-by-sa | commons | 38 | 0.8 | text is available under the creative commons attribution share ?alike license
cc-by | creativecommons | 58 | 1.0 | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | 62 | 1.0 | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons | 62 | 1.0 | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons | 62 | 1.0 | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons | 66 | 1.0 | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | 66 | 1.0 | creativecommons org licenses by nc nd [1-4] [05]
cc0 | creativecommons | 62 | 1.0 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | 56 | 0.95 | creativecommons org publicdomain mark 1 0
public-domain | domain | 50 | 0.9 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | 42 | 0.8 | (?:this|the) (?:work|file|code|software|text) is (?:in )?(?:the )?public domain
gfdl | documentation | 56 | 1.0 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | fdl | 45 | 0.9 | (?:gnu )?fdl version 1 [123]
ofl | font | 56 | 1.0 | this font software is licensed under the sil open font license version 1 1
ofl | reserved | 36 | 0.8 | with reserved font name
odbl | database | 54 | 1.0 | made available under the open database license
odc-by | commons | 54 | 1.0 | made available under the open data commons attribution license
pddl | commons | 52 | 0.95 | open data commons public domain dedication and license
ogl | government | 52 | 0.95 | open government licence(?: v ?[123](?: 0)?)?
python-2 | python | 50 | 0.95 | python software foundation license version 2
php-3 | php | 54 | 1.0 | this source file is subject to version 3 01? of the php license
openssl | openssl | 50 | 0.95 | this product includes software developed by the openssl project
ssleay | eric | 50 | 0.95 | this product includes cryptographic software written by eric young
sspl | server | 54 | 1.0 | server side public license(?: version 1| v ?1)?
busl | business | 52 | 0.95 | business source license 1 1
elastic-2 | elastic | 52 | 0.95 | elastic license (?:2 0|v2)
commons-clause | clause | 50 | 0.9 | commons clause license condition(?: v ?1 0)?
json | evil | 40 | 0.9 | the software shall be used for good not evil
beerware | beer | 48 | 0.95 | the beer ?ware license
afl | academic | 48 | 0.95 | academic free license (?:version )?[123](?: [012])?
osl | open | 46 | 0.9 | open software license (?:version |v )?[123](?: [01])?
upl | universal | 48 | 0.95 | universal permissive license
ncsa | illinois | 50 | 0.95 | university of illinois ncsa open source license
w3c | w3c | 48 | 0.95 | w3c software (?:and document )?(?:notice and )?license
unicode | unicode | 48 | 0.95 | unicode license (?:agreement|v3)
llama | llama | 48 | 0.95 | llama [23](?: [123])? community license(?: agreement)?
openrail | rail | 50 | 0.95 | (?:creativeml )?open rail(?: m| plus plus m)? license
proprietary | reserved | 10 | 0.4 | all rights reserved
proprietary | confidential | 20 | 0.6 | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | 20 | 0.6 | unauthorized (?:copying|use|reproduction|distribution)(?: or \w+)? of this (?:file|software|document|material|work)(?: via any medium)? is strictly prohibited
proprietary | reproduced | 18 | 0.5 | no part of this (?:publication|book|work|document) may be reproduced
proprietary | written | 16 | 0.5 | without (?:the )?(?:prior|express) written (?:permission|consent) of the (?:author|publisher|copyright (?:holder|owner)|company)
proprietary | internal | 14 | 0.4 | for internal use only
non-commercial | commercial | 30 | 0.6 | for (?:personal and |research and |educational and )?non ?commercial (?:use|purposes) only
non-commercial | commercial | 26 | 0.5 | commercial use (?:of this \w+ )?is (?:not permitted|prohibited|forbidden)
research-only | research | 30 | 0.6 | for (?:academic )?research (?:use|purposes) only
mit | sublicense | 19 | 0.6 | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial | 17 | 0.55 | shall be included in all copies or substantial portions of the software
mit | mit | 36 | 0.9 | (?:dual|double|multi) licensed under (?:the )?mit
mit | mit | 37 | 0.9 | mit style license
mit | opensource | 57 | 1.0 | opensource org licenses mit(?: license)?(?: php| html)?
mit-modern | royalty | 21 | 0.6 | permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software
x11 | x | 40 | 0.9 | except as contained in this notice the name of the x consortium shall not be used in advertising
curl | advertising | 30 | 0.8 | except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
ntp | representations | 24 | 0.7 | makes no representations about the suitability (?:of )?this software for any purpose it is provided as is without express or implied warranty
hpnd | advertising | 25 | 0.7 | not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior permission
bsd | contributors | 14 | 0.5 | in no event shall the (?:copyright (?:holder|holders|owner|owners)|regents|authors?) (?:or|and) contributors be liable for any direct indirect incidental
bsd | regents | 18 | 0.6 | provided by the regents and contributors as is
bsd-3-clause | specific | 27 | 0.8 | the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | bsd | 46 | 0.95 | governed by a bsd style license that can be found in the license file
bsd-3-clause-clear | patent | 33 | 0.85 | no express or implied licenses to any party s patent rights are granted by this license
bsd-2-clause-patent | bsd | 52 | 0.95 | bsd (?:2|two) clause plus patent license
apache-2 | apache | 45 | 0.95 | dual licensed under (?:the )?apache(?: license)?(?: version)? 2 0
apache-2 | notices | 23 | 0.6 | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2 | patent | 23 | 0.7 | if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit
apache-2 | asf | 40 | 0.9 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2-llvm | llvm | 64 | 1.0 | apache(?: license)?(?: version| v)? ?2 0 with llvm exceptions?
apache-1.1 | documentation | 30 | 0.8 | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
gpl | freedom | 20 | 0.6 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3 | copyleft | 28 | 0.8 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | gpl|gpled | 35 | 0.85 | (?:this|the) (?:project|software|code|library|package|program|file) is (?:gpl|gpl licensed|gpled)
gpl-2 | foundation | 25 | 0.7 | free software foundation inc (?:51 franklin street|59 temple place|675 mass ave)
gpl-2 | gpl | 48 | 0.95 | gpl (?:version )?2 or (?:any )?later
gpl-3 | gpl | 48 | 0.95 | gpl (?:version )?3 or (?:any )?later
gpl-3 | gnu | 47 | 0.9 | gnu gpl ?v?3(?: 0)?
gpl-2 | gnu | 47 | 0.9 | gnu gpl ?v?2(?: 0)?
gpl-2-linux | syscall | 62 | 1.0 | gpl 2 0(?: only| or later)? with linux syscall note
gpl-3-gcc | gcc | 62 | 1.0 | gcc runtime library exception
gpl-autoconf | autoconf | 60 | 0.9 | (?:with|as a) (?:the )?(?:special )?(?:autoconf exception|exception .{0,80}autoconf)
gpl-bison | bison | 45 | 0.9 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
lgpl | lesser | 27 | 0.7 | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
lgpl | lgpl | 35 | 0.85 | (?:this|the) (?:project|software|code|library|package|program|file) is (?:lgpl|lgpl licensed)
lgpl-2.1 | lgpl | 61 | 1.0 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | lgpl | 61 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 | agpl | 61 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | affero | 29 | 0.75 | you should have received a copy of the gnu affero general public license along with this program
mpl-2 | secondary | 30 | 0.7 | incompatible with secondary licenses as defined by the mozilla public license v 2 0
mpl-1.1 | initial | 24 | 0.7 | the initial developer of the original code is
mpl-gpl-lgpl | alternatively | 34 | 0.8 | alternatively the contents of this file may be used under the terms of either the gnu general public license
npl | netscape | 50 | 0.95 | netscape public license(?: version)?(?: 1 [01])?
epl-2 | eclipse | 53 | 1.0 | www eclipse org legal epl (?:2 0|v20)(?: html)?
epl-1 | eclipse | 53 | 1.0 | www eclipse org legal epl v10(?: html)?
edl | eclipse | 50 | 0.95 | eclipse distribution license (?:version |v )?1 0
cecill | cecill | 48 | 0.95 | (?:licence |license )?cecill(?: b| c)?(?: version)?(?: 2 [01])?
mulan | mulan | 52 | 0.95 | mulan (?:psl|permissive software license)(?: v ?2)?
ecl | educational | 50 | 0.95 | educational community license(?: version)? 2 0
bsl-1 | boost | 52 | 1.0 | www boost org license 1 0(?: txt)?
blueoak | oak | 52 | 0.95 | blue oak model license(?: 1 0 0)?
cc0 | dedicated | 42 | 0.85 | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | commons | 35 | 0.75 | except where otherwise noted content on this (?:site|page|wiki) is licensed under a creative commons attribution
cc-by-nc | commercial | 38 | 0.8 | you may not use the (?:material|work) for commercial purposes
cc-by-sa | remix | 36 | 0.75 | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by | credit | 34 | 0.7 | you must give appropriate credit provide a link to the license and indicate if changes were made
unlicense | unlicense | 58 | 1.0 | (?:https? )?unlicense org
gfdl | invariant | 36 | 0.8 | with no invariant sections no front cover texts and no back cover texts
ofl | embedded | 30 | 0.7 | fonts? (?:are|is) allowed to be embedded in any document
bitstream-vera | bitstream | 50 | 0.95 | bitstream vera fonts? copyright
openrail | restrictions | 40 | 0.8 | use based restrictions as referenced in paragraph
gemma | gemma | 50 | 0.95 | gemma (?:terms of use|prohibited use policy)
llama | llama | 46 | 0.9 | built with (?:meta )?llama(?: [23])?
cc-by-nc | commons | 56 | 0.9 | creative commons non ?commercial license
polyform | polyform | 52 | 0.95 | polyform (?:noncommercial|small business|shield|strict|perimeter) license(?: 1 0 0)?
non-commercial | commercial | 24 | 0.5 | may not be used for (?:any )?commercial purposes?
no-derivatives | transform|derivative | 20 | 0.4 | you may not (?:alter transform or build upon|create derivative works)
proprietary | trade | 18 | 0.5 | (?:contains|constitutes) (?:confidential |proprietary )*(?:information and )?trade secrets of
proprietary | eula | 20 | 0.5 | end user license agreement eula
"""


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[frozenset[str], ...]  # one word at least of each
    priority: int
    score: float


def rules() -> list[Rule]:
    """The signatures, and every name in every context, by falling priority."""
    either = lambda words: frozenset(words.split("|"))
    out = []
    for label, name, tag, words, specific in NAMES:
        for kind, context, needs, priority, score in CONTEXTS:
            if label in PRODUCTS and kind == "title":
                context = rf"(?:the )?{{name}} {LICENSE} (?:version|v) ?\d+(?: \d+)?"
            pattern = context.replace("{name}", f"(?:{name})").replace("{tag}", f"(?:{tag})")
            keywords = (either(needs),) if "{tag}" in context else (either(needs), either(words))
            out.append(Rule(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), keywords, priority + specific, score))
        if label in PLAIN:
            out.append(Rule(label, re.compile(rf"(?<![^ ])(?:{name})(?![^ ])"), (either(words),), 41 + specific, 0.75))
    for line in SIGNATURES.strip().split("\n"):
        label, needs, priority, score, pattern = line.split(" | ")
        out.append(Rule(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), (either(needs),), int(priority), float(score)))
    return sorted(out, key=lambda r: (-r.priority, r.label))


FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def below(at: int) -> Iterator[int]:
    """The places of a binary indexed tree that together cover 1..at."""
    while at:
        yield at
        at &= at - 1


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What stands between "license" and its name in a field, and what may follow a name that is alone on its line.
FIELD_SIGN, LINE_REST = re.compile(rb"[:=|>({\[\"]"), re.compile(rb"[^0-9A-Za-z\x80-\xff\n]*(?:\n|\Z)")


class Fields:
    """Tells which matches in a text's joined words are fields of the text itself; its words' places are found once, when first asked."""

    def __init__(self, data: bytes, joined: str):
        self.data, self.joined = data, joined

    @cached_property
    def places(self) -> tuple[array, array, array]:
        """Each word's start and end in the text, and the spaces of the joined words."""
        return array("q", (m.start() for m in WORD.finditer(self.data))), array("q", (m.end() for m in WORD.finditer(self.data))), array("q", (m.start() for m in re.finditer(" ", self.joined)))

    def __call__(self, match: re.Match) -> bool:
        """Whether a sign of a field stands before the match's name, or the name is alone on its line."""
        starts, ends, spaces = self.places
        first, last = (bisect_left(spaces, x) for x in match.span("field"))
        gap = self.data[ends[first - 1] : starts[first]]
        return bool(FIELD_SIGN.search(gap)) or (b"\n" in gap and bool(LINE_REST.match(self.data, ends[last])))


class Scanner:
    def __init__(self):
        self.rules = rules()
        often = Counter(k for r in self.rules for need in r.keywords for k in need)
        self.index: dict[str, list[int]] = defaultdict(list)  # the rules by the words of their rarest need
        for i, rule in enumerate(self.rules):
            for k in min(rule.keywords, key=lambda need: sum(often[k] for k in need)):
                self.index[k].append(i)
        self.keywords = {k.encode() for r in self.rules for need in r.keywords for k in need}
        self.base = {f" {p} ".encode(): label for p, label in BASE.items()}

    def detections(self, text: str, present: set[str], fields: Fields | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of what stays after suppression; text: joined words. Without `fields` every match of a field counts."""
        found = []
        for rule in (self.rules[i] for i in sorted({i for k in present for i in self.index.get(k, ())})):
            if all(need & present for need in rule.keywords):
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text) if fields is None or not rule.pattern.groupindex or fields(m)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0]))
        kept: list[tuple[int, int, str, float]] = []
        starts = sorted({x[0] for x in found})
        reach = [0] * (len(starts) + 1)  # a binary indexed tree of the furthest end kept so far, by start
        for start, end, rule in found:
            at = bisect_right(starts, start)
            if not any(reach[k] >= end for k in below(at)):
                kept.append((start, end, rule.label, rule.score))
                while at <= len(starts):
                    reach[at] = max(reach[at], end)
                    at += at & -at
        return kept

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = data.translate(FOLD).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        joined = b" ".join(words)
        padded, places, base = b" " + joined + b" ", [], set()
        for phrase, label in self.base.items():
            at, word, counted = padded.find(phrase), 0, 0
            while at >= 0:
                word, counted = word + padded.count(b" ", counted, at), at
                places.append(word)
                base.add(label)
                at = padded.find(phrase, at + 1)
        plain = joined.decode("utf-8", "replace")
        found = self.detections(plain, {x.decode() for x in present}, Fields(data, plain))
        labels = base | {x[2] for x in found}
        score = 1.0 if base else max((x[3] for x in found), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, no labels, score 0. Repeated rows are scanned each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            columns = list(zip(*map(scanner.scan, texts(batch)))) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
