"""License signatures, in the order of their priority.

Texts are matched as lower-case words with one space between them; a rule's pattern
must begin and end with whole words. A line holds the label, the certainty, the
keywords (a text must have one of them, joined by ``|``, as a word) and the pattern.
Notices and identifiers that name a version come first, then titles and names,
then phrases that only point at a family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Wordings and identifiers of published licenses.
RULES = r"""
apache-2 1.00 apache licensed under the apache license version 2( 0)?
apache-2 1.00 compliance you may not use this file except in compliance with the license .{0,60}apache org licenses license 2 0
apache-2 1.00 apache spdx license identifier apache 2( 0)?
apache-2 0.99 apache www apache org licenses license 2 0( txt| html)?
apache-2 0.99 apache apache license version 2( 0)?( january 2004)?
apache-2 0.97 apache apache( software)? license v?2( 0)?
apache-2 0.96 apache apache 2( 0)? licensed?
apache-2 0.96 apache|apache2 (under|licensed|license) (the )?(apache 2( 0)?|apache2)
apache-1.1 1.00 apache apache software license version 1 1
apache-1.1 0.97 apache spdx license identifier apache 1 1
apache-1.0 0.97 apache apache( software)? license( version)? 1 0
mit 1.00 permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 1.00 mit spdx license identifier mit
mit 1.00 mit (released|licensed|distributed|available|provided|published|offered) under the( terms of the)? mit license
mit 0.99 mit opensource org licenses mit( license)?( php| html)?
mit 0.99 mit under the( terms of( the)?)? mit( open source)? licen[cs]e
mit 0.98 mit the mit license( mit)?
mit 0.97 mit mit licen[cs]ed
mit 0.96 mit mit licen[cs]e
mit 0.96 expat expat licen[cs]e
mit-0 1.00 mit spdx license identifier mit 0
mit-0 0.98 mit mit no attribution
mit-0 0.97 mit mit 0 licen[cs]e
x11 0.98 x11 x11 licen[cs]e
x11 0.97 x11|mit mit x11( licen[cs]e)?
isc 1.00 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 1.00 isc spdx license identifier isc
isc 0.98 isc (under )?the isc licen[cs]e
isc 0.96 isc isc licen[cs]ed?
0bsd 1.00 0bsd spdx license identifier 0bsd
0bsd 0.97 0bsd 0bsd licen[cs]e
0bsd 0.97 bsd bsd zero clause licen[cs]e
bsd-4-clause 1.00 advertising all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause 1.00 bsd spdx license identifier bsd 4 clause
bsd-4-clause 0.98 bsd (bsd 4 clause|4 clause bsd|four clause bsd|original bsd)( licen[cs]e)?
bsd-3-clause 1.00 neither neither the names? of .{1,80} nor the names of (its|their) contributors may be used to endorse or promote products
bsd-3-clause 1.00 bsd spdx license identifier bsd 3 clause
bsd-3-clause 0.98 bsd (bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)( licen[cs]e)?
bsd-3-clause 0.98 bsd opensource org licenses bsd 3 clause
bsd-3-clause-clear 1.00 bsd (spdx license identifier )?bsd 3 clause clear( licen[cs]e)?
bsd-2-clause 1.00 bsd spdx license identifier bsd 2 clause
bsd-2-clause 0.98 bsd|freebsd (bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)( licen[cs]e)?
bsd-2-clause 0.98 bsd opensource org licenses bsd 2 clause
bsd-2-clause 0.95 freebsd freebsd( documentation)? licen[cs]e
bsd-2-clause-patent 1.00 bsd bsd 2 clause (plus )?patent( licen[cs]e)?
bsd 0.90 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 0.90 bsd (under )?(the |a )?bsd (style )?licen[cs]ed?
agpl-3-or-later 1.00 agpl spdx license identifier agpl 3 0 or later
agpl-3-only 1.00 agpl spdx license identifier agpl 3 0( only)?
agpl-3-or-later 0.99 affero gnu affero general public license .{0,60}version 3 .{0,40}or .{0,20}any later version
agpl-3 0.99 affero gnu affero general public license( as published by the free software foundation)?( either)?( version| v) ?3( 0)?
agpl-3 0.98 agpl|agplv|agplv3|agpl3 (gnu )?(agpl ?v? ?3( 0)?|agplv3|agpl3)( licen[cs]e)?
agpl 0.93 affero (gnu )?affero general public licen[cs]e
agpl 0.90 agpl (under |licensed )(the )?(gnu )?agpl
lgpl-3-or-later 1.00 lgpl spdx license identifier lgpl 3 0 or later
lgpl-3-only 1.00 lgpl spdx license identifier lgpl 3 0( only)?
lgpl-2.1-or-later 1.00 lgpl spdx license identifier lgpl 2 1 or later
lgpl-2.1-only 1.00 lgpl spdx license identifier lgpl 2 1( only)?
lgpl-2-or-later 1.00 lgpl spdx license identifier lgpl 2 0 or later
lgpl-3 0.99 lesser (gnu )?lesser general public license( as published by the free software foundation)?( either)?( version| v) ?3( 0)?
lgpl-2.1 0.99 lesser (gnu )?lesser general public license( as published by the free software foundation)?( either)?( version| v) ?2 1
lgpl-2 0.99 library gnu library general public license( as published by the free software foundation)?( either)?( version| v) ?2( 0)?
lgpl-3 0.98 lgpl|lgplv|lgplv3|lgpl3 (gnu )?(lgpl ?v? ?3( 0)?|lgplv3|lgpl3)( licen[cs]e)?
lgpl-2.1 0.98 lgpl|lgpl2|lgplv|lgplv2 (gnu )?(lgpl ?v? ?2 1|lgplv2 1)( licen[cs]e)?
lgpl-2 0.96 lgpl|lgpl2|lgplv|lgplv2 (gnu )?(lgpl ?v? ?2( 0)?|lgplv2)( licen[cs]e)?
lgpl 0.93 lesser (gnu )?lesser general public licen[cs]e
lgpl 0.93 library (gnu )?library general public licen[cs]e
lgpl 0.90 lgpl (under |licensed )(the )?(gnu )?lgpl
gpl-3-or-later 1.00 gpl spdx license identifier gpl 3 0 or later
gpl-3-only 1.00 gpl spdx license identifier gpl 3 0( only)?
gpl-2-or-later 1.00 gpl spdx license identifier gpl 2 0 or later
gpl-2-only 1.00 gpl spdx license identifier gpl 2 0( only)?
gpl-1-or-later 1.00 gpl spdx license identifier gpl 1 0 or later
gpl-3-or-later 1.00 general gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version
gpl-2-or-later 1.00 general gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version
gpl-2-classpath 1.00 classpath (gpl|general public license) .{0,40}with (the )?classpath exception
gpl-3 0.99 general gnu general public license( as published by the free software foundation)?( either)?( version| v) ?3( 0)?
gpl-2 0.99 general gnu general public license( as published by the free software foundation)?( either)?( version| v) ?2( 0)?
gpl-1 0.98 general gnu general public license( as published by the free software foundation)?( either)?( version| v) ?1( 0)?
gpl-3 0.98 gpl|gplv|gplv3|gpl3 (gnu )?(gpl ?v? ?3( 0)?|gplv3|gpl3)( licen[cs]e)?
gpl-2 0.98 gpl|gplv|gplv2|gpl2 (gnu )?(gpl ?v? ?2( 0)?|gplv2|gpl2)( licen[cs]e)?
gpl 0.93 general (gnu )?general public licen[cs]e
gpl 0.92 gnu www gnu org licenses gpl( \d \d)?( html| txt)?
gpl 0.90 gpl (under |licensed )(the )?(gnu )?gpl
gfdl-1.3 1.00 gfdl spdx license identifier gfdl 1 3( or later| only)?
gfdl-1.2 1.00 gfdl spdx license identifier gfdl 1 2( or later| only)?
gfdl-1.3 0.99 documentation gnu free documentation license version 1 3
gfdl-1.2 0.99 documentation gnu free documentation license version 1 2
gfdl-1.1 0.99 documentation gnu free documentation license version 1 1
gfdl 0.95 documentation (gnu )?free documentation licen[cs]e
gfdl 0.92 gfdl (gnu |the )?gfdl
mpl-2 1.00 mozilla this source code form is subject to the terms of the mozilla public license v(ersion)? ?2 0
mpl-2 1.00 mpl spdx license identifier mpl 2 0
mpl-2 0.99 mozilla mozilla public license( version| v)? ?2( 0)?
mpl-2 0.98 mozilla mozilla org mpl 2 0
mpl-2 0.97 mpl|mplv|mplv2|mpl2 (mpl ?v? ?2( 0)?|mplv2|mpl2)( licen[cs]e)?
mpl-1.1 1.00 mpl spdx license identifier mpl 1 1
mpl-1.1 0.99 mozilla mozilla public license( version| v)? ?1 1
mpl-1.1 0.97 mpl|mpl1|mplv|mplv1 mpl ?v? ?1 1
mpl-1.0 0.98 mozilla mozilla public license( version| v)? ?1 0
mpl 0.93 mozilla mozilla public licen[cs]e
epl-2 1.00 epl spdx license identifier epl 2 0
epl-1 1.00 epl spdx license identifier epl 1 0
epl-2 0.99 eclipse eclipse public license( version| v)? ?2( 0)?
epl-1 0.99 eclipse eclipse public license( version| v)? ?1( 0)?
epl-2 0.97 epl|epl2|eplv|eplv2 (epl ?v? ?2( 0)?|eplv2)
epl-1 0.97 epl|epl1|eplv|eplv1 (epl ?v? ?1( 0)?|eplv1)
epl 0.93 eclipse eclipse public licen[cs]e
edl-1 0.97 eclipse eclipse distribution license( version| v)?( 1 0)?
cddl-1.0 1.00 cddl spdx license identifier cddl 1 0
cddl-1.1 1.00 cddl spdx license identifier cddl 1 1
cddl-1.0 0.98 common common development and distribution license( cddl)?( version)? 1 0
cddl-1.1 0.98 common common development and distribution license( cddl)?( version)? 1 1
cddl 0.95 distribution common development and distribution licen[cs]e
cddl 0.92 cddl (the )?cddl( licen[cs]e)?
cpl-1 0.98 common common public license( version| v)? ?1 0
cpl-1 0.97 cpl spdx license identifier cpl 1 0
cpal-1 0.98 attribution common public attribution license( version)?( 1 0)?
ipl-1 0.98 ibm ibm public license( version)?( 1 0)?
eupl-1.2 1.00 eupl|eupl1|euplv|euplv1 (spdx license identifier )?eupl ?v? ?1 2
eupl-1.1 1.00 eupl|eupl1|euplv|euplv1 (spdx license identifier )?eupl ?v? ?1 1
eupl-1.2 0.99 european european union public licen[cs]e( eupl)?( version| v)? ?1 2
eupl 0.95 european european union public licen[cs]e
cecill-2.1 0.98 cecill (cecill 2 1|cecill version 2 1)
cecill-b 0.98 cecill cecill b
cecill-c 0.98 cecill cecill c
cecill 0.93 cecill cecill( free software)?( license)?
osl-3 0.99 osl|open (spdx license identifier )?(osl 3 0|open software license( version| v)? ?3 0)
osl-2.1 0.98 osl|open (osl 2 1|open software license( version| v)? ?2 1)
osl 0.92 open open software licen[cs]e
afl-3 0.98 afl|academic (afl 3 0|academic free license( version| v)? ?3 0)
afl-2.1 0.98 afl|academic (afl 2 1|academic free license( version| v)? ?2 1)
afl 0.92 academic academic free licen[cs]e
artistic-2 0.99 artistic (spdx license identifier )?(artistic 2 0|artistic license( version)? 2( 0)?)
artistic-1 0.98 artistic (spdx license identifier )?(artistic 1 0|artistic license( version)? 1( 0)?)
artistic 0.93 artistic (the )?(perl )?artistic licen[cs]e
bsl-1 1.00 boost boost software license( version)? 1 0
bsl-1 0.99 bsl spdx license identifier bsl 1 0
bsl-1 0.95 boost boost( software)? licen[cs]e
busl-1.1 1.00 busl spdx license identifier busl 1 1
busl-1.1 0.98 business business source license( version)?( 1 1)?
sspl-1 1.00 sspl spdx license identifier sspl 1 0
sspl-1 0.98 server server side public licen[cs]e
elastic-2 0.98 elastic elastic license( version| v)? ?2( 0)?
elastic 0.93 elastic elastic licen[cs]e
confluent 0.96 confluent confluent community licen[cs]e
commons-clause 0.97 clause commons clause (licen[cs]e )?(condition|restriction)
polyform-nc-1 0.98 polyform polyform noncommercial( license)?( 1 0 0)?
polyform-sb-1 0.98 polyform polyform small business( license)?( 1 0 0)?
polyform-shield-1 0.98 polyform polyform shield( license)?( 1 0 0)?
polyform-strict-1 0.98 polyform polyform strict( license)?( 1 0 0)?
unlicense 1.00 unencumbered this is free and unencumbered software released into the public domain
unlicense 0.99 unlicense (spdx license identifier |the |under the )?unlicense
unlicense 0.98 unlicense unlicense org
wtfpl 0.99 wtfpl (the )?wtfpl( version 2)?
wtfpl 0.99 fuck do what the fuck you want to public licen[cs]e
zlib 1.00 zlib spdx license identifier zlib
zlib 0.97 zlib (the )?zlib( libpng)? licen[cs]e
zlib 0.97 origin the origin of this software must not be misrepresented
libpng 0.97 libpng libpng licen[cs]e
postgresql 0.98 postgresql (the )?postgresql licen[cs]e
python-2 0.98 python|psf (psf|python software foundation) license( version)?( 2)?
python-2 0.97 python|psf spdx license identifier (psf|python) 2 0
ruby 0.96 ruby (the )?ruby licen[cs]e
php-3.01 0.98 php php license( version)? 3 01
php-3 0.97 php php license( version)?( 3( 0)?)?
openssl 0.97 openssl openssl licen[cs]e
openldap-2.8 0.97 openldap openldap public license( version)?( 2 8)?
w3c 0.97 w3c w3c (software( notice)?( and)?( document)?|document) licen[cs]e
ncsa 0.98 ncsa (university of illinois )?ncsa( open source)? licen[cs]e
ecl-2 0.98 ecl|educational (educational community license( version)? 2( 0)?|ecl 2 0)
upl-1 0.98 upl|universal (universal permissive license( version| v)?( 1 0)?|upl 1 0)
ms-pl 0.98 microsoft microsoft public licen[cs]e
ms-rl 0.98 microsoft microsoft reciprocal licen[cs]e
ms-pl 0.96 ms spdx license identifier ms pl
ms-rl 0.96 ms spdx license identifier ms rl
qpl-1 0.97 qpl|public (q public license( version)?( 1 0)?|qpl 1 0)
sil-ofl-1.1 1.00 ofl spdx license identifier ofl 1 1
sil-ofl-1.1 0.99 sil sil open font license( version)? 1 1
sil-ofl-1.0 0.99 sil sil open font license( version)? 1 0
sil-ofl 0.95 font (sil )?open font licen[cs]e
lppl-1.3c 0.98 lppl|latex (lppl 1 3c|latex project public license( version)? 1 3c?)
lppl 0.93 latex latex project public licen[cs]e
vim 0.95 vim (the )?vim licen[cs]e
curl 0.96 curl (the )?curl licen[cs]e
json 0.97 good the software shall be used for good not evil
beerware 0.97 beerware|beer (the )?beer ?ware licen[cs]e
blueoak-1 0.98 oak|blueoak blue ?oak model license( version)?( 1 0 0)?
blueoak-1 0.98 blueoak spdx license identifier blueoak 1 0 0
mulan-psl-2 0.98 mulan mulan psl( v|version )?2?|mulan permissive software license( version| v)?( 2)?
ncgl-uk-2 0.96 commercial non commercial government licen[cs]e
ogl-uk-3 0.98 open open government licen[cs]e( version| v)? ?3( 0)?
ogl-uk 0.93 government open government licen[cs]e
odbl-1 1.00 odbl (spdx license identifier )?odbl( v)?( 1 0)?
odbl-1 0.98 database open database licen[cs]e( version| v)?( 1 0)?
odc-by-1 0.98 odc odc by( 1 0)?
odc-by-1 0.97 commons open data commons attribution licen[cs]e
pddl-1 0.98 pddl|public (pddl( 1 0)?|open data commons public domain dedication and licen[cs]e)
cdla-permissive-2 0.98 cdla cdla permissive 2 0
cdla-permissive-1 0.98 cdla cdla permissive 1 0
cdla-sharing-1 0.98 cdla cdla sharing 1 0
cdla-permissive-1 0.96 community community data license agreement permissive
cdla-sharing-1 0.96 community community data license agreement sharing
llama-2 0.97 llama llama 2 community licen[cs]e( agreement)?
llama-3 0.97 llama llama 3 community licen[cs]e( agreement)?
openrail-m 0.96 openrail|openrailm (creativeml |bigscience )?(big ?code )?openrail ?(m|\+\+)?
rail 0.94 rail|responsible (responsible ai|bigscience rail|bigscience bloom rail) licen[cs]e
hippocratic-2.1 0.97 hippocratic hippocratic license( version)?( 2 1)?
parity-7 0.96 parity parity public license( 7 0 0)?
ethical-source 0.94 ethical ethical source licen[cs]e
cc-by-nc-sa 1.00 nc spdx license identifier cc by nc sa \d \d
cc-by-nc-nd 1.00 nc spdx license identifier cc by nc nd \d \d
cc-by-nc 1.00 nc spdx license identifier cc by nc \d \d
cc-by-sa 1.00 sa spdx license identifier cc by sa \d \d
cc-by-nd 1.00 nd spdx license identifier cc by nd \d \d
cc-by 1.00 cc spdx license identifier cc by \d \d
cc0-1 1.00 cc0 spdx license identifier cc0 1 0
cc-by-nc-sa 0.99 creativecommons creativecommons org licenses by nc sa( \d \d)?
cc-by-nc-nd 0.99 creativecommons creativecommons org licenses by nc nd( \d \d)?
cc-by-nc 0.99 creativecommons creativecommons org licenses by nc( \d \d)?
cc-by-sa 0.99 creativecommons creativecommons org licenses by sa( \d \d)?
cc-by-nd 0.99 creativecommons creativecommons org licenses by nd( \d \d)?
cc-by 0.99 creativecommons creativecommons org licenses by( \d \d)?
cc0-1 0.99 creativecommons creativecommons org publicdomain zero( 1 0)?
cc-pdm-1 0.98 creativecommons creativecommons org publicdomain mark( 1 0)?
cc-by-nc-sa 0.98 creative creative commons attribution non ?commercial share ?alike( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by-nc-nd 0.98 creative creative commons attribution non ?commercial no ?deriv(ative|atives|s)?( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by-nc 0.98 creative creative commons attribution non ?commercial( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by-sa 0.98 creative creative commons attribution share ?alike( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by-nd 0.98 creative creative commons attribution no ?deriv(ative|atives|s)?( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by 0.98 creative creative commons attribution( \d \d)?( international| unported| generic)?( public)?( licen[cs]e)?
cc0-1 0.98 creative creative commons (zero|cc0)( 1 0)?( universal)?( public domain dedication)?
cc-by-nc-sa 0.97 cc cc by nc sa( \d \d)?( licen[cs]e)?
cc-by-nc-nd 0.97 cc cc by nc nd( \d \d)?( licen[cs]e)?
cc-by-nc 0.97 cc (licensed under )?cc by nc( \d \d)?( licen[cs]e)?
cc-by-sa 0.97 cc cc by sa( \d \d)?( licen[cs]e)?
cc-by-nd 0.97 cc cc by nd( \d \d)?( licen[cs]e)?
cc-by 0.96 cc cc by \d \d( licen[cs]e)?
cc-by 0.93 cc (under|licensed) (the )?cc by( licen[cs]e)?
cc0-1 0.96 cc0 cc0( 1 0)?( universal)?( public domain dedication)?
cc 0.85 creative (under|with) (a |the )?creative commons licen[cs]e
public-domain 0.92 domain (released|dedicated|placed) (in|into|to) the public domain
public-domain 0.85 domain this (work|text|file|software|document) is in the public domain
proprietary 0.90 confidential (proprietary and confidential|confidential and proprietary)
proprietary 0.88 prohibited unauthori[sz]ed (copying|distribution|reproduction) .{0,60}strictly prohibited
all-rights-reserved 0.80 reserved all rights reserved
non-commercial 0.80 commercial|noncommercial (for )?non ?commercial (use|purposes) only
non-commercial 0.80 noncommercial for noncommercial (use|purposes)( only)?
research-only 0.80 research for research (use|purposes) only
"""


@dataclass(frozen=True)
class Rule:
    label: str
    score: float
    keywords: frozenset[str]
    pattern: re.Pattern


def load_rules(table: str = RULES) -> list[Rule]:
    rules = []
    for line in filter(None, map(str.strip, table.splitlines())):
        label, score, keywords, pattern = line.split(maxsplit=3)
        whole = re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")
        rules.append(Rule(label, float(score), frozenset(keywords.split("|")), whole))
    return rules
