"""Hand-written licence signatures, and the keywords that follow from them.

A signature is a regular expression over lower-cased text in which a blank stands for any white space, with or without
the mark of a comment line after it (``GAP``). ``keywords`` derives from the expression itself what every match must
contain, so a prefilter built on it can't be stricter than its rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

try:
    from re import _parser as sre
except ImportError:  # Python 3.10
    import sre_parse as sre

GAP = r"(?:\s+(?:(?:\*+|#+|/{2,})\s*)?)"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    family: str
    priority: int  # higher wins
    weight: float  # 0..1, how surely a match means the licence
    pattern: str
    needs: tuple[tuple[str, ...], ...] = field(default=())  # every match holds one string of each group


#: Kinds of rules: priority and weight.
KINDS = {"spdx": (90, 1.0), "address": (85, 0.95), "grant": (80, 0.95), "field": (70, 0.9), "title": (60, 0.8), "notice": (50, 0.9), "clause": (45, 0.7), "owner": (40, 0.6), "family": (30, 0.6)}

# Signatures as "kind label family: pattern", in order within a kind.
SIGNATURES = r"""
title mit mit: (?:the )?(?:mit|expat|x11)(?:[-/]style)? licen[cs]e
title mit mit: (?:licen[cs]e|licen[cs]ed)[:]? (?:mit|expat)\b
grant mit mit: (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat|x11)\b
notice mit mit: permission is hereby granted, free of charge, to any person obtaining a copy
clause mit mit: to deal in the software without restriction, including without limitation the rights
clause mit mit: the above copyright notice and this permission notice shall be included in all copies
clause mit mit: the software is provided ["“”'’]*as is["“”'’]*, without warranty of any kind, express or implied
clause mit mit: in no event shall the authors or copyright holders be liable for any claim
notice mit-0 mit: permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,400}? without restriction, .{0,400}? to do so\. the software is provided
title apache-1.0 apache: apache (?:software )?licen[cs]e,? (?:version |v)?1\.0
title apache-1.1 apache: apache (?:software )?licen[cs]e,? (?:version |v)?1\.1
title apache-2.0 apache: apache (?:software )?licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?\b
title apache-2.0 apache: \b(?:apache|asl|apl)[- ]?(?:v|version )?2(?:\.0)?\b
grant apache-2.0 apache: licen[cs]ed under the apache licen[cs]e,? version 2\.0
grant apache-2.0 apache: (?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e,? (?:version |v)?2
notice apache-2.0 apache: you may not use this file except in compliance with the licen[cs]e
notice apache-2.0 apache: unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an
clause apache-2.0 apache: contributed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements
clause apache-2.0 apache: see the notice file distributed with this work for additional information regarding copyright ownership
clause apache-2.0 apache: grant of patent licen[cs]e\. subject to the terms and conditions of this licen[cs]e
clause apache-1.1 apache: this product includes software developed by the apache software foundation
clause apache-1.1 apache: products derived from this software may not be called ["“”'’]*apache
address apache-2.0 apache: apache\.org/licenses/license-2\.0
address apache-1.1 apache: apache\.org/licenses/license-1\.1
title gpl-1.0 gpl: gnu general public licen[cs]e,?(?: version| v\.?) ?1(?:\.0)?\b
title gpl-2.0 gpl: gnu general public licen[cs]e,?(?: version| v\.?) ?2(?:\.0)?\b
title gpl-3.0 gpl: gnu general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)?\b
title gpl-2.0 gpl: \b(?:gnu )?gpl(?:[- ]?v| version )2(?:\.0)?\b
title gpl-3.0 gpl: \b(?:gnu )?gpl(?:[- ]?v| version )3(?:\.0)?\b
grant gpl-2.0 gpl: gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2
grant gpl-3.0 gpl: gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3
grant gpl gpl: (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[cs]e)\b
notice gpl gpl: free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
notice gpl gpl: but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose
clause gpl gpl: you should have received a copy of the gnu general public licen[cs]e
clause gpl gpl: everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
clause gpl gpl: the licenses for most software (?:and other practical works )?are designed to take away your freedom
clause gpl gpl: this general public licen[cs]e does not permit incorporating your program into proprietary programs
clause gpl-classpath gpl: as a special exception, the copyright holders of this library give you permission to link
clause gpl-classpath gpl: classpath exception to the (?:gpl|gnu general public licen[cs]e)
clause gpl-gcc gpl: gcc runtime library exception
address gpl gpl: gnu\.org/(?:copyleft|licenses)/gpl(?:-[123]\.0)?(?:\.\w+)?
title lgpl-2.0 lgpl: gnu (?:library|lesser) general public licen[cs]e,?(?: version| v\.?) ?2(?:\.0)?\b
title lgpl-2.1 lgpl: gnu (?:library|lesser) general public licen[cs]e,?(?: version| v\.?) ?2\.1
title lgpl-3.0 lgpl: gnu lesser general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)?\b
title lgpl-2.1 lgpl: \blgpl(?:[- ]?v| version |-)2\.1\b
title lgpl-3.0 lgpl: \blgpl(?:[- ]?v| version |-)3(?:\.0)?\b
grant lgpl lgpl: (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)\b
notice lgpl lgpl: free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
clause lgpl lgpl: you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
clause lgpl lgpl: this licen[cs]e, the lesser general public licen[cs]e, applies to some specially designated software packages
address lgpl lgpl: gnu\.org/(?:copyleft|licenses)/lgpl
title agpl-3.0 agpl: gnu affero general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)?\b
title agpl-3.0 agpl: \bagpl(?:[- ]?v| version |-)3(?:\.0)?\b
title agpl-1.0 agpl: affero general public licen[cs]e,?(?: version| v\.?) ?1(?:\.0)?\b
notice agpl-3.0 agpl: under the terms of the gnu affero general public licen[cs]e as published by
clause agpl-3.0 agpl: your modified version must prominently offer all users interacting with it remotely through a computer network
clause agpl-3.0 agpl: you should have received a copy of the gnu affero general public licen[cs]e
address agpl-3.0 agpl: gnu\.org/licenses/agpl
title gfdl-1.1 gfdl: gnu free documentation licen[cs]e,?(?: version| v\.?) ?1\.1
title gfdl-1.2 gfdl: gnu free documentation licen[cs]e,?(?: version| v\.?) ?1\.2
title gfdl-1.3 gfdl: gnu free documentation licen[cs]e,?(?: version| v\.?) ?1\.3
title gfdl gfdl: \b(?:gnu free documentation licen[cs]e|gfdl)\b
clause gfdl gfdl: with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
title bsd-2-clause bsd: \b(?:(?:2|two)[- ]clause|simplified|freebsd) bsd\b
title bsd-2-clause bsd: \bbsd[- ](?:2|two)[- ]clause\b
title bsd-3-clause bsd: \b(?:(?:3|three)[- ]clause|new|modified|revised) bsd\b
title bsd-3-clause bsd: \bbsd[- ](?:3|three)[- ]clause\b
title bsd-4-clause bsd: \b(?:(?:4|four)[- ]clause|original) bsd\b
title bsd-4-clause bsd: \bbsd[- ](?:4|four)[- ]clause\b
title 0bsd bsd: \b(?:zero[- ]clause bsd|bsd zero[- ]clause|0bsd)\b
grant bsd bsd: (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the |a )?(?:terms of (?:the |a )?)?(?:\d-clause )?bsd\b
notice bsd bsd: redistribution and use in source and binary forms, with or without modification, are permitted
clause bsd bsd: redistributions of source code must retain the above copyright notice
clause bsd bsd: redistributions in binary form must reproduce the above copyright notice
clause bsd-3-clause bsd: neither the name of .{1,120}? nor the names of (?:its|his|their|any) contributors may be used to endorse or promote
clause bsd-4-clause bsd: all advertising materials mentioning features or use of this software must display
clause bsd-3-clause-clear bsd: no express or implied licenses to any party's patent rights are granted by this licen[cs]e
clause bsd-2-clause-patent bsd: each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual
clause bsd-protection bsd: \bbsd protection licen[cs]e\b
clause bsd bsd: this software is provided by the (?:copyright holders|authors?|regents|project) (?:and contributors )?["“”'’`]*as is["“”'’]* and any express or implied warranties
title mpl-1.0 mpl: mozilla public licen[cs]e,?(?: version| v\.?) ?1\.0
title mpl-1.1 mpl: mozilla public licen[cs]e,?(?: version| v\.?) ?1\.1
title mpl-2.0 mpl: mozilla public licen[cs]e,?(?: version| v\.?) ?2(?:\.0)?\b
title mpl-2.0 mpl: \bmpl(?:[- ]?v| version |-)?2(?:\.0)\b
notice mpl-2.0 mpl: this source code form is subject to the terms of the mozilla public licen[cs]e
notice mpl-1.1 mpl: the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
clause mpl-2.0 mpl: this source code form is ["“”'’]*incompatible with secondary licenses
clause mpl-1.1 mpl: the initial developer of the original code is
address mpl-2.0 mpl: mozilla\.org/mpl/2\.0
address mpl-1.1 mpl: mozilla\.org/mpl/(?:mpl-)?1\.1
title epl-1.0 epl: eclipse public licen[cs]e,? ?(?:version |-? ?v ?)?1\.0
title epl-2.0 epl: eclipse public licen[cs]e,? ?(?:version |-? ?v ?)?2\.0
title edl-1.0 bsd: eclipse distribution licen[cs]e
notice epl epl: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
address epl-1.0 epl: eclipse\.org/legal/epl-v10
address epl-2.0 epl: eclipse\.org/legal/epl-2\.0
title cddl-1.0 cddl: common development and distribution licen[cs]e,? ?\(?(?:cddl\)?,? ?)?(?:version |v)?1\.0
title cddl-1.1 cddl: common development and distribution licen[cs]e,? ?\(?(?:cddl\)?,? ?)?(?:version |v)?1\.1
title cddl cddl: common development and distribution licen[cs]e
notice cddl cddl: subject to the terms of the common development and distribution licen[cs]e
title cpl-1.0 cpl: common public licen[cs]e(?:,? (?:version |v)?1\.0)?
title ipl-1.0 ipl: \bibm public licen[cs]e
title cpal-1.0 cpal: common public attribution licen[cs]e
title isc isc: \b(?:the )?isc(?:[-/]style)? licen[cs]e
grant isc isc: (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc\b
notice isc isc: permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
clause isc isc: the author disclaims all warranties with regard to this software
clause isc isc: internet (?:systems|software) consortium
title zlib zlib: \bzlib(?:/libpng)? licen[cs]e
notice zlib zlib: this software is provided ['"’]as-is['"’], without any express or implied warranty
clause zlib zlib: altered source versions must be plainly marked as such
clause zlib zlib: the origin of this software must not be misrepresented
title libpng libpng: \b(?:libpng licen[cs]e|png reference library)
title unlicense unlicense: \bthe unlicen[cs]e\b
notice unlicense unlicense: this is free and unencumbered software released into the public domain
clause unlicense unlicense: anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
address unlicense unlicense: \bunlicense\.org
title wtfpl wtfpl: \b(?:do what the f\S{2}k you want to public licen[cs]e|wtfpl)\b
clause wtfpl wtfpl: you just do what the f\S{2}k you want to
title bsl-1.0 boost: \bboost software licen[cs]e
notice bsl-1.0 boost: distributed under the boost software licen[cs]e, version 1\.0
clause bsl-1.0 boost: permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
address bsl-1.0 boost: boost\.org/license_1_0
title artistic-1.0 artistic: \bartistic licen[cs]e,? ?(?:version |v)?1(?:\.0)?\b
title artistic-2.0 artistic: \bartistic licen[cs]e,? ?(?:version |v)?2(?:\.0)?\b
title artistic-1.0-perl artistic: \bclarified artistic licen[cs]e
grant artistic-perl artistic: under the same terms as perl itself
clause artistic artistic: the intent of this document is to state the conditions under which a package may be copied
title psf-2.0 psf: \bpython software foundation licen[cs]e(?: version 2)?
title python-2.0 psf: \bpython licen[cs]e(?: 2\.0|,? version 2)
clause psf-2.0 psf: this licen[cs]e agreement is between the python software foundation
title cnri-python psf: \bcnri (?:open source )?licen[cs]e agreement
title ofl-1.1 ofl: \bsil open font licen[cs]e(?:,? version 1\.1)?
notice ofl-1.1 ofl: this font software is licen[cs]ed under the sil open font licen[cs]e
clause ofl ofl: the font software may be sold as part of a larger software package
address ofl ofl: scripts\.sil\.org/ofl
title eupl-1.1 eupl: european union public licen[cs]e,? ?(?:\(?eupl\)? ?)?(?:version |v\.? ?)?1\.1
title eupl-1.2 eupl: european union public licen[cs]e,? ?(?:\(?eupl\)? ?)?(?:version |v\.? ?)?1\.2
title eupl eupl: \beuropean union public licen[cs]e
grant eupl eupl: licen[cs]ed under the eupl\b
title sspl-1.0 sspl: \bserver side public licen[cs]e
clause sspl-1.0 sspl: if you make the functionality of the program or a modified version available to third parties as a service
title busl-1.1 busl: \bbusiness source licen[cs]e(?: 1\.1)?
clause busl-1.1 busl: the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use
clause busl-1.1 busl: \bchange date[:] .{1,60}? change licen[cs]e[:]
title elastic-2.0 elastic: \belastic licen[cs]e,? ?(?:version |v)?2(?:\.0)?\b
title elastic-1.0 elastic: \belastic licen[cs]e agreement
clause elastic-2.0 elastic: you may not provide the software to third parties as a hosted or managed service
title commons-clause commons-clause: \bcommons clause(?: licen[cs]e)?(?: condition)?\b
clause commons-clause commons-clause: does not grant to you, the right to sell the software
title polyform polyform: \bpolyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use)(?: licen[cs]e)?
title confluent confluent: \bconfluent community licen[cs]e
title timescale timescale: \btimescale licen[cs]e
title redis redis: \bredis source available licen[cs]e
title fsl fsl: \bfunctional source licen[cs]e
title prosperity prosperity: \bprosperity public licen[cs]e
title parity parity: \bparity public licen[cs]e
title blueoak-1.0.0 blueoak: \bblue oak model licen[cs]e
title ms-pl ms: \bmicrosoft public licen[cs]e
title ms-rl ms: \bmicrosoft reciprocal licen[cs]e
title ms-lpl ms: \bmicrosoft limited public licen[cs]e
clause ms ms: if you bring a patent claim against any contributor over patents that you claim are infringed by the software
title osl-1.0 osl: \bopen software licen[cs]e,? ?(?:version |v\.? ?)?1\.0
title osl-2.1 osl: \bopen software licen[cs]e,? ?(?:version |v\.? ?)?2\.1
title osl-3.0 osl: \bopen software licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?\b
title afl-2.1 afl: \bacademic free licen[cs]e,? ?(?:version |v\.? ?)?2\.1
title afl-3.0 afl: \bacademic free licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?\b
notice afl afl: licen[cs]ed under the academic free licen[cs]e
title ecl-2.0 ecl: \beducational community licen[cs]e
title ncsa ncsa: \b(?:university of illinois/)?ncsa open source licen[cs]e
clause ncsa ncsa: to deal with the software without restriction, including without limitation the rights
title upl-1.0 upl: \buniversal permissive licen[cs]e
title w3c w3c: \bw3c(?:®)? software (?:notice and )?(?:and document )?licen[cs]e
clause w3c w3c: by obtaining(?:, using and/or copying)? this work, you \(the licensee\) agree
title postgresql postgresql: \bpostgresql licen[cs]e
clause postgresql postgresql: permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
title openssl openssl: \bopenssl(?: and ssleay)? licen[cs]e
clause openssl openssl: this product includes software developed by the openssl project
clause openssl openssl: this product includes cryptographic software written by eric young
title openldap openldap: \bopenldap public licen[cs]e
title php-3.01 php: \bphp licen[cs]e,? ?(?:version |v)?3\.01
title php-3.0 php: \bphp licen[cs]e,? ?(?:version |v)?3\.0\b
clause php php: this product includes php software, freely available from
title ruby ruby: \b(?:the )?ruby(?:'s)? licen[cs]e
grant ruby ruby: under the same terms as ruby itself
title vim vim: \b(?:the )?vim(?:'s)? licen[cs]e
title curl curl: \bcurl licen[cs]e
title ijg ijg: \bindependent jpeg group(?:'s)?\b
title freetype ftl: \bfreetype (?:project )?licen[cs]e
title tcl tcl: \btcl/tk licen[cs]e
title sleepycat sleepycat: \bsleepycat (?:public )?licen[cs]e
title qpl-1.0 qpl: \bq public licen[cs]e
title lppl-1.3c lppl: \blatex project public licen[cs]e(?:,? ?(?:version |v)?1\.3c?)?
notice lppl lppl: this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e
title hpnd hpnd: \bhistorical permission notice and disclaimer
title beerware beerware: \bbeer-?ware licen[cs]e
clause beerware beerware: you can buy me a beer in return
title json json: \bjson licen[cs]e
clause json json: shall be used for good, not evil
title cecill cecill: \bcecill(?:-[abc]|-2\.[01])?(?: free software)? (?:licen[cs]e|agreement)
title mulanpsl-2.0 mulan: \bmulan (?:permissive software|psl) ?(?:licen[cs]e)?(?:,? ?(?:version |v)?2)?
title odbl odbl: \bopen (?:data commons open )?database licen[cs]e
title odc-by odc: \bopen data commons attribution licen[cs]e
title pddl odc: \bpublic domain dedication and licen[cs]e
title cdla-permissive cdla: \bcommunity data licen[cs]e agreement[ –-]{1,4}permissive
title cdla-sharing cdla: \bcommunity data licen[cs]e agreement[ –-]{1,4}sharing
title ogl ogl: \bopen government licen[cs]e(?:,? ?(?:version |v)?[123](?:\.0)?)?
title openrail openrail: \b(?:creativeml |bigscience )?open ?rail(?:-?\+?\+?-?[mds])?(?: licen[cs]e)?\b
title llama llama: \bllama (?:[234](?:\.\d)? )?community licen[cs]e
title rail rail: \bresponsible ai licen[cs]e
title hippocratic hippocratic: \bhippocratic licen[cs]e
title nasa-1.3 nasa: \bnasa open source agreement
title intel intel: \bintel (?:open source|simplified software) licen[cs]e
title oracle oracle: \boracle (?:binary code|technology network|free use) (?:terms|licen[cs]e)
title sun sun: \bsun (?:industry standards source|public) licen[cs]e
title nvidia nvidia: \bnvidia (?:software|cuda|source code) licen[cs]e
title opl opl: \bopen publication licen[cs]e
title cc0-1.0 cc: \bcc0(?:[- ]1\.0)?\b
title cc0-1.0 cc: \bcc zero\b
notice cc0-1.0 cc: to the extent possible under law, .{1,120}? has waived all copyright
title cc-by cc: creative commons attribution(?: ?[\d.]+)?(?: international| unported| generic)?(?: public)? licen[cs]e
title cc-by-sa cc: creative commons attribution[- ]share-?alike
title cc-by-nd cc: creative commons attribution[- ]no-?deriv(?:ative)?s
title cc-by-nc cc: creative commons attribution[- ]non-?commercial(?! ?-? ?(?:share|no))
title cc-by-nc-sa cc: creative commons attribution[- ]non-?commercial[- ]share-?alike
title cc-by-nc-nd cc: creative commons attribution[- ]non-?commercial[- ]no-?deriv
family cc cc: \bcreative commons\b
notice public-domain public-domain: \b(?:released|placed|dedicated|donated) (?:in)?to the public domain\b
notice public-domain public-domain: \b(?:is|are|was) (?:hereby )?(?:placed )?in the public domain\b
clause public-domain public-domain: the authors? disclaims? (?:all )?copyright to this (?:source code|software)
owner proprietary proprietary: \ball rights reserved\b
owner proprietary proprietary: \bproprietary and confidential\b
owner proprietary proprietary: \bunauthori[sz]ed (?:copying|use|distribution|reproduction) (?:of this \w{1,30} )?(?:, via any medium )?is (?:strictly )?prohibited\b
owner proprietary proprietary: \bthis (?:software|document|file) (?:is|contains) (?:the )?(?:confidential|trade secrets?)\b
owner proprietary proprietary: \b(?:no part of this|this) (?:publication|book|work|document) may (?:not )?be reproduced\b
owner proprietary proprietary: \bend[- ]user licen[cs]e agreement\b
owner proprietary proprietary: \bfor (?:personal|internal|evaluation|non-?commercial) use only\b
family apache apache: \bapache licen[cs]e\b
family gpl gpl: \bgeneral public licen[cs]e\b
family gpl gpl: \bgpl\b
family lgpl lgpl: \blgpl\b
family agpl agpl: \bagpl\b
family bsd bsd: \bbsd[- ](?:style )?licen[cs]e\b
family mpl mpl: \bmozilla public licen[cs]e\b
family epl epl: \beclipse public licen[cs]e\b
family artistic artistic: \bartistic licen[cs]e\b
family copyleft copyleft: \bcopyleft licen[cs]e\b
family open-source open-source: \bopen[- ]source licen[cs]e\b
"""

# Identifiers for SPDX tags, licence fields and addresses, as "family: identifiers".
IDENTIFIERS = """
mit: mit mit-0 x11
apache: apache-1.0 apache-1.1 apache-2.0
gpl: gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later
lgpl: lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
agpl: agpl-3.0 agpl-3.0-only agpl-3.0-or-later
gfdl: gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later
bsd: bsd-2-clause bsd-3-clause bsd-4-clause 0bsd
mpl: mpl-1.1 mpl-2.0
epl: epl-1.0 epl-2.0
cddl: cddl-1.0
cpl: cpl-1.0
isc: isc
zlib: zlib
unlicense: unlicense
wtfpl: wtfpl
boost: bsl-1.0
artistic: artistic-2.0
psf: psf-2.0 python-2.0
ofl: ofl-1.1
eupl: eupl-1.2
sspl: sspl-1.0
busl: busl-1.1
ms: ms-pl
osl: osl-3.0
afl: afl-3.0
postgresql: postgresql
openssl: openssl
php: php-3.01
ruby: ruby
vim: vim
"""
CC_CLAUSES = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def spaced(signature: str) -> str:
    """The regular expression of a signature: blanks become gaps (a blank in a class: any one white space)."""
    classes = lambda m: GAP if m[0] == " " else f"(?:-|{GAP})" if m[0] == "[- ]" else m[0].replace(" ", r"\s")
    return re.sub(r"\[[^\]]*\]| ", classes, signature)


def keywords(pattern: str, most: int = 2) -> tuple[tuple[str, ...], ...]:
    """Groups of strings: each match of ``pattern`` holds at least one string of every group; the longest few groups.

    A run of letters that must stand together is a group of one; alternatives that all have a run are a group of those.
    """
    found = sorted(_needed(sre.parse(pattern)), key=lambda g: (-min(map(len, g)), len(g), sorted(g)))
    return tuple(tuple(sorted(g)) for i, g in enumerate(found[:most]) if not i or min(map(len, g)) > 3)


def _needed(nodes) -> list[set[str]]:
    out: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) > 1:
            out.append({run})
        run = ""

    for op, arg in nodes:
        if op is sre.LITERAL and not chr(arg).isspace():
            run += chr(arg)
            continue
        if op is sre.AT:
            continue
        close()
        if op is sre.SUBPATTERN:
            out += _needed(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            out += _needed(arg[2])
        elif op is sre.BRANCH:
            sides = [_needed(side) for side in arg[1]]
            if all(sides):  # the longest run of every alternative
                out.append({max((min(g, key=len) for g in side if len(g) == 1), key=len, default="") for side in sides})
                if "" in out[-1]:
                    out.pop()
    close()
    return out


def build_rules() -> tuple[Rule, ...]:
    """The signatures, then tags, fields and addresses of the identifiers and the Creative Commons grid, by priority."""
    out: list[Rule] = []

    def add(kind: str, label: str, family: str, name: str, pattern: str) -> None:
        out.append(Rule(name, label, family, *KINDS[kind], pattern, keywords(pattern)))

    for n, line in enumerate(SIGNATURES.strip().splitlines()):
        head, pattern = line.split(": ", 1)
        kind, label, family = head.split()
        add(kind, label, family, f"{kind}:{label}:{n}", rf"(?<!\w)(?:{spaced(pattern)})")
    for line in IDENTIFIERS.strip().splitlines():
        family, names = line.split(": ")
        for tag in names.split():
            plain = {"x11": "mit", "python-2.0": "psf-2.0"}.get(tag, tag).removesuffix("-only").removesuffix("-or-later")
            end = r"(?![\w.+-]*\w)"
            add("spdx", plain, family, f"spdx:{tag}", rf"spdx-license-identifier:\s*\(?{re.escape(tag)}{end}")
            add("field", plain, family, f"field:{tag}", rf"\blicen[cs]e\"?\s*[:=]\s*[\"']?{re.escape(tag)}{end}")
            add("address", plain, family, f"address:{tag}", rf"opensource\.org/licen[cs]es?/{re.escape(tag)}{end}")
    for clauses in CC_CLAUSES:
        for version in CC_VERSIONS:
            tag = f"cc-{clauses}-{version}"
            add("grant", tag, "cc", f"name:{tag}", spaced(rf"\bcc[- ]{clauses}[- ]{re.escape(version)}(?![\d.]*\d)"))
            add("address", tag, "cc", f"address:{tag}", rf"creativecommons\.org/licenses/{clauses}/{re.escape(version)}")
    return tuple(sorted(out, key=lambda r: -r.priority))
