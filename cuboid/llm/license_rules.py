"""Hand-written signatures of licenses and notices, over lower-case words with single spaces.

Each line: label | keyword, which every match holds (a space stands in it where a word ends) | priority | expression.
Priorities: 5 sentences of a license's own text, 4 grants, 3 statements and titles that name one license, 2 names, 1 hints.
"""

from __future__ import annotations

import re

# Wordings of licenses, as their texts have them.
_LINES = """
mit|software without restriction|5|to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit|permission notice shall|5|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|noninfringement|3|merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
mit-0|hereby granted|5|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-advertising|distributions of the software|5|all distributions of the software must display the following acknowledgement
expat|expat|2|expat licen[cs]e
jquery|jquery|2|dual licensed under the mit and gpl licenses jquery
x11|advertising or otherwise|5|shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
x11|x consortium|2|x consortium licen[cs]e
isc|notice appear in all copies|5|provided that the above copyright notice and this permission notice appear in all copies
isc|internet systems consortium|2|internet systems consortium licen[cs]e
bsd|source code must retain|5|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd|binary form must reproduce|5|redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-4-clause|mentioning features|5|all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause|without specific prior written permission|4|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-1-clause|1 clause|2|(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd-0-clause|0 clause|2|(?:bsd 0 clause|0 clause bsd|zero clause bsd 0 clause)(?: licen[cs]e)?
bsd-0-clause|zero clause|2|(?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?
bsd-patent|bsd 2 clause plus patent|3|bsd 2 clause plus patent licen[cs]e
bsd-clear|clear bsd|2|clear bsd licen[cs]e
bsd-clear|express or implied licenses|5|no express or implied licenses to any party s patent rights are granted by this license
bsd-nuclear|nuclear facility|5|not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
apache-2.0|unless required by applicable law|5|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0|grant of copyright license|5|grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you
apache-2.0|grant of patent license|5|grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
apache-2.0|www apache org licenses|3|www apache org licenses license 2 0
apache-2.0|apache 2|2|apache 2(?: 0)? licen[cs]e
apache-1.0|apache group|5|this product includes software developed by the apache group for use in the apache http server project
apache-1.1|developed by the apache software foundation|5|this product includes software developed by the apache software foundation
gpl|free software you can redistribute|5|is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl|copy of the gnu general public|5|you should have received a copy of the gnu general public license along with this program
gpl|preamble the licenses|5|preamble the licenses for most software are designed to take away your freedom to share and change it
gpl|guarantee your freedom|5|intended to guarantee your freedom to share and change (?:free software|all versions of a program)
gpl-3.0|copyleft license for software|5|the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0-only|version 2 of the license|4|general public license as published by the free software foundation version 2 of the license
gpl-2.0-or-later|either version 2|4|either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later|either version 3|4|either version 3 of the license or (?:at your option )?any later version
gpl-classpath|classpath exception|3|(?:gnu )?classpath exception
gpl-classpath|independent module|5|an independent module is a module which is not derived from or based on this library
gpl-linking|linking exception|3|linking exception to the (?:gnu )?(?:gpl|general public license)
gcc-exception|gcc runtime library exception|3|gcc runtime library exception(?: version 3 1)?
gpl|copyleft|1|(?:strong |weak )?copyleft
lgpl|lesser general public license for more|5|see the gnu lesser general public license for more details
lgpl|library general public license for more|5|see the gnu library general public license for more details
lgpl-2.1|lesser general public license applies|5|this license the lesser general public license applies to some specially designated software packages
lgpl|no derivative of any portion|5|a program that contains no derivative of any portion of the library but is designed to work with the library
agpl-3.0|with it remotely|5|prominently offer all users interacting with it remotely|interact with it remotely
agpl-3.0|ensure cooperation with the community|5|specifically designed to ensure cooperation with the community in the case of network server software
agpl-1.0|affero|2|affero general public license (?:version )?1(?: 0)?
gfdl|invariant sections|5|with no invariant sections no front cover texts and no back cover texts
gfdl|invariant sections|4|with the invariant sections being
gfdl-1.1|free documentation license version 1 1|3|gnu free documentation license version 1 1
gfdl-1.2|free documentation license version 1 2|3|gnu free documentation license version 1 2
gfdl-1.3|free documentation license version 1 3|3|gnu free documentation license version 1 3
mpl-2.0|mozilla org mpl|3|(?:obtain one at )?https? mozilla org mpl 2 0
mpl-2.0|incompatible with secondary licenses|5|this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1|contents of this file are subject to the mozilla|5|the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0|mozilla public license|3|mozilla public license (?:version )?1 0
mpl|mpl|1|mpl ?(?:v ?)?[12](?: [01])?
npl-1.1|netscape public|3|netscape public license(?: (?:version )?1 [01])?
epl-1.0|acceptance of this agreement|5|any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
epl-2.0|eclipse org legal epl|3|(?:available at )?https? www eclipse org legal epl 2 0
epl-1.0|eclipse org legal epl v10|3|https? www eclipse org legal epl v10(?: html)?
edl-1.0|eclipse distribution|3|eclipse distribution license(?: v? ?1 0)?
cddl-1.1|cddl 1 1|3|cddl 1 1
cddl|common development and distribution|3|common development and distribution license(?: (?:version )?1 [01])?
cddl|cddl header|5|cddl header start the contents of this file are subject to the terms
cpl-1.0|accompanying program is provided|5|the accompanying program is provided under the terms of this common public license agreement
ipl-1.0|ibm public|3|ibm public license(?: (?:version )?1 0)?
cpal-1.0|common public attribution|3|common public attribution license(?: (?:version )?1 0)?
eupl-1.1|european union public licence v 1 1|3|european union public licence v 1 1
eupl|eupl|2|eupl(?: v? ?1 [0-2])?
cecill-2.1|cecill|3|cecill(?: b| c)?(?: (?:version )?[12] [01])?
zlib|origin of this software|5|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|express or implied warranty in no event|5|provided as is without any express or implied warranty in no event will the authors be held liable
libpng|libpng|2|libpng licen[cs]e(?: version 2)?
bsl-1.0|machine executable object|5|solely in the form of machine executable object code generated by a source language processor
artistic-2.0|package may be copied|5|under which a given free software package may be copied modified distributed
artistic-1.0|standard version|5|standard version refers to such a package if it has not been modified
perl|same terms as perl|4|(?:under )?the same terms as perl itself
clarified-artistic|clarified artistic|3|clarified artistic license
psf-2.0|python software foundation|5|this license agreement is between the python software foundation psf and the individual or organization
python-2.0|beopen|3|beopen python open source license agreement version 1
cnri-python|cnri|3|cnri (?:open source )?license agreement
ruby|ruby licen|2|ruby licen[cs]e
php-3.0|php license|3|php license version 3 0
php-3.01|includes php software|5|this product includes php software freely available from
zend-2.0|zend|3|zend (?:engine )?licen[cs]e(?: version 2 0)?
postgresql|regents of the university|3|portions copyright c [0-9]{4}(?: [0-9]{4})? the regents of the university of california
postgresql|hereby granted provided|5|with or without fee and without a written agreement is hereby granted provided that
ofl-1.1|sil open font|4|licensed under the sil open font license version 1 1
ofl-1.1|reserved font name|5|(?:with )?reserved font name
ofl-1.0|open font license version 1 0|3|open font license version 1 0
bitstream-vera|bitstream vera|3|bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)
ubuntu-font|ubuntu font|3|ubuntu font licen[cs]e(?: version 1 0)?
gust-font|gust font|3|gust font (?:nosource )?license
ipa-font|ipa font|3|ipa font license agreement(?: v? ?1 0)?
freetype|freetype|3|freetype (?:project )?licen[cs]e
freetype|freetype project|5|portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project
ijg|independent jpeg group|5|based in part on the work of the independent jpeg group
openssl|openssl toolkit|5|developed by the openssl project for use in the openssl toolkit
ssleay|eric young|5|this product includes cryptographic software written by eric young
curl|curl licen|2|curl licen[cs]e
icu|unicode inc|3|unicode inc license agreement data files and software
unicode|unicode licen|2|unicode licen[cs]e(?: v3)?
w3c|w3c|3|w3c software (?:notice and |and document )?(?:notice and )?license
sleepycat|sleepycat|3|sleepycat (?:software )?(?:public )?licen[cs]e
ncsa|university of illinois|3|university of illinois (?:open source|ncsa open source) license
ncsa|ncsa open source|2|ncsa open source license
llvm-exception|llvm exception|3|apache 2 0 with llvm exceptions?
upl-1.0|universal permissive|3|universal permissive license(?: v? ?1 0)?
afl-3.0|academic free|3|academic free license(?: (?:version |v )?[123] [0-2])?
osl-3.0|open software license|3|open software license(?: (?:version |v )?[123] [01])?
ecl-2.0|educational community|3|educational community license(?: version [12] 0)?
apsl-2.0|apple public source|3|apple public source license(?: version [12] [0-2])?
qpl-1.0|q public|3|q public license(?: version 1 0)?
lppl-1.3c|latex project public|3|latex project public license(?: (?:version )?1 [0-3]c?)?
lppl-1.3c|lppl|2|lppl(?: version)? ?1 [0-3]c?
nasa-1.3|nasa open source|3|nasa open source agreement(?: version 1 3)?
mulan-psl-2.0|mulan|3|mulan (?:psl|permissive software license)(?: v? ?2(?: 0)?)?
mirnos|miros|2|miros licen[cs]e
zpl-2.1|zope public|3|zope public license(?: zpl)?(?: version 2 [01])?
vim|vim licen|2|vim licen[cs]e
tcl|tcl tk|2|tcl tk licen[cs]e
watcom-1.0|sybase open watcom|3|sybase open watcom public license(?: version 1 0)?
sissl|sun industry standards|3|sun industry standards source license
bcl-java|binary code license|3|(?:sun microsystems inc |oracle )?binary code license agreement
oracle-nftc|no fee terms|3|oracle no fee terms and conditions
json|good not evil|5|the software shall be used for good not evil
beerware|beer|3|beer ?ware license
beerware|buy me a beer|4|if (?:we meet some day and you think|you think) this stuff is worth it you can buy me a beer in return
wtfpl|do what the|3|do what the f.{1,4} you want to(?: public license)?
unlicense|free to copy modify publish|5|anyone is free to copy modify publish use compile sell or distribute this software
0bsd|copy modify and or distribute this software for any purpose with or without fee|5|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
fair|usage of the works|5|usage of the works is permitted provided that this instrument is retained with the works
hpnd|historical permission|3|historical permission notice and disclaimer
ntp|ntp licen|2|ntp licen[cs]e
cc0-1.0|waived all copyright|5|(?:has |have )?waived all copyright and related or neighboring rights
cc0-1.0|public domain dedication|3|cc0 (?:1 0 )?public domain dedication|public domain dedication
cc0-1.0|creative commons zero|3|creative commons zero(?: v? ?1 0)?(?: universal)?
cc-by|creative commons attribution license|2|creative commons attribution license
cc-by-sa|creative commons attribution|2|creative commons attribution share ?alike licen[cs]e
cc-by-nc|creative commons attribution non|2|creative commons attribution non ?commercial licen[cs]e
cc|creativecommons org|1|creativecommons org licenses(?: by(?: nc)?(?: sa| nd)?(?: [1-4] [05])?)?
cc-sampling|sampling plus|3|creative commons sampling plus(?: 1 0)?
odbl-1.0|odbl|2|odbl(?: v? ?1 0)?
pddl-1.0|pddl|3|pddl(?: 1 0)?|public domain dedication and licen[cs]e pddl
odc-by|odc by|2|odc by(?: 1 0)?
ogl-uk-3.0|open government licen|3|open government licen[cs]e(?: v? ?[123](?: 0)?)?
ogl-uk-3.0|contains public sector information|5|contains public sector information licensed under the
etalab-2.0|licence ouverte|3|licence ouverte(?: open licence)?(?: (?:version )?[12] 0)?
dl-de-by-2.0|datenlizenz deutschland|3|datenlizenz deutschland(?: namensnennung| zero)?(?: (?:version )?2 0)?
cdla-permissive|community data license|3|community data license agreement(?: permissive| sharing)?(?: (?:version )?[12] 0)?
c-uda|computational use of data|3|computational use of data agreement
rail|responsible ai licen|3|(?:creativeml |bigscience |bigcode )?(?:open )?responsible ai licen[cs]es?
rail|use based restrictions|5|use based restrictions as referenced in paragraph 5
openrail++|openrail m 1|2|openrail m 1
research-only|research purposes only|2|for (?:non commercial )?(?:academic )?research purposes only
research-only|non commercial research|2|non commercial research (?:use|purposes?|licen[cs]e)
non-commercial|non commercial use only|2|for non commercial use only
non-commercial|noncommercial use|2|(?:for )?noncommercial use(?: only)?
polyform|polyform|3|polyform (?:noncommercial|small business|shield|strict|free trial|internal use) license(?: 1 0 0)?
prosperity|prosperity public|3|prosperity public license(?: 3 0 0)?
parity|parity public|3|parity public license(?: 7 0 0)?
busl-1.1|business source|3|business source license(?: 1 1)?
sspl-1.0|server side public|3|server side public license(?: v? ?1)?
elastic-2.0|elastic license|3|elastic license(?: 2 0)?
confluent|confluent community|3|confluent community license
redis-sal|redis source available|3|redis source available license(?: 2 0)?
commons-clause|commons clause|3|commons clause(?: license condition)?(?: v? ?1 0)?
commons-clause|the right to sell|5|the grant of rights under the license will not include and the license does not grant to you the right to sell the software|does not include the right to sell the software
fsl-1.1|functional source|3|functional source license(?: (?:version )?1 1)?
ms-rl|microsoft reciprocal|3|microsoft reciprocal license
ms-eula|microsoft software license|3|microsoft software license terms
nvidia-eula|nvidia|2|nvidia (?:software|source code|cuda toolkit) (?:end user )?license(?: agreement)?
eula|end user licen|2|end user licen[cs]e agreement
eula|eula|1|eula
eula|installing copying or otherwise using|5|by installing copying or otherwise using the software you agree to be bound
proprietary|confidential and proprietary information|4|(?:is|are|contains?) (?:the )?confidential and proprietary information of
proprietary|trade secret|2|(?:contains?|are|is|constitutes?) (?:valuable )?trade secrets? (?:of|and)
proprietary|is strictly prohibited|4|unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|document|software) )?(?:via any medium )?is strictly prohibited
proprietary|for internal use only|2|for internal use only
proprietary|not for redistribution|2|not for redistribution
proprietary|without the prior written permission|2|(?:reproduced|distributed|transmitted|copied) (?:in any form )?(?:or by any means )?without the prior written permission
proprietary|may be reproduced|2|no part of this (?:publication|document|book|work) may be reproduced
proprietary|evaluation purposes only|2|for evaluation purposes only
source-available|source available|1|source available licen[cs]e
shareware|shareware|2|shareware(?: version)?
freeware|freeware|2|freeware
royalty-free|royalty free|1|royalty free(?: license)?
royalty-free|perpetual worldwide non exclusive|4|perpetual worldwide non exclusive no charge royalty free irrevocable
rights-managed|rights managed|2|rights managed(?: licen[cs]e)?
editorial-only|editorial use only|2|for editorial use only
fair-use|fair use|1|(?:constitutes? |considered )?fair use(?: notice)?
us-government|restricted rights|3|restricted rights (?:legend|notice)
us-government|work of the united states government|3|(?:is )?a work of the united states government
public-domain|no known copyright|3|no known copyright restrictions
public-domain|in the public domain|2|(?:is|are) in the public domain
public-domain|public domain|1|public domain
crown-copyright|crown copyright|2|(?:c )?crown copyright
dual-license|dual licen|3|(?:is )?dual licensed(?: under)?
multi-license|at your option under|3|at your option under (?:either of )?
contributor-agreement|contributor license agreement|2|contributor license agreement
dco|certificate of origin|3|developer certificate of origin(?: (?:version )?1 1)?
patent-grant|additional grant of patent|3|additional grant of patent rights(?: version 2)?
trademark|registered trademark|1|(?:is|are) (?:a )?registered trademarks?(?: of)?
no-derivatives|no derivative works|2|no derivative works(?: are allowed)?
share-alike|share alike|1|share alike
attribution|attribution required|2|attribution required
non-military|military purposes|2|(?:not|never) (?:be )?used for military purposes
hippocratic|hippocratic|3|hippocratic license(?: (?:version )?[123] [01])?
anti-996|anti 996|3|anti 996 licen[cs]e(?: (?:version )?1 0)?
arr-worldwide|rights reserved worldwide|2|all rights reserved worldwide
lizenz|alle rechte vorbehalten|1|alle rechte vorbehalten
lizenz|tous droits|1|tous droits réservés
lizenz|todos los derechos|1|todos los derechos reservados
lizenz|unter der lizenz|1|unter der lizenz
licence-libre|sous licence|1|sous licence (?:libre|creative commons)
"""


def signatures() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) of each line; alternatives in an expression are whole ones."""
    out = []
    for line in _LINES.strip().splitlines():
        label, word, priority, pattern = line.split("|", 3)
        out.append((label, word, pattern, int(priority)))
    return out


#: What stands for a character that an expression leaves open, and the most wordings of one that are listed.
_OPEN, _MOST = "\0", 4096


def wordings(pattern: str) -> list[str] | None:
    """All texts that an expression matches, with ``_OPEN`` for what it leaves open; None if there are too many."""
    parser = re._parser

    def of(parts) -> list[str]:
        out = [""]
        for op, x in parts:
            if op is parser.LITERAL:
                own = [chr(x)]
            elif op is parser.IN and all(k is parser.LITERAL for k, _ in x):
                own = [chr(v) for _, v in x]
            elif op is parser.BRANCH:
                own = [t for branch in x[1] for t in of(branch)]
            elif op is parser.SUBPATTERN:
                own = of(x[3])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and x[1] == 1:
                own = [""] * (not x[0]) + of(x[2])
            else:
                own = [_OPEN]
            out = [a + b for a in out for b in own]
            if len(out) > _MOST:
                raise OverflowError
        return out

    try:
        return of(parser.parse(pattern))
    except OverflowError:
        return None


def covering(pattern: str) -> tuple[str, ...] | None:
    """Words of which every match has one whole: long ones, and as few as can be; None if some wording has none."""
    texts = wordings(pattern)
    if texts is None:
        return None
    sets, out = [{w for w in t.split(" ") if len(w) > 1 and _OPEN not in w} for t in texts], []
    if not all(sets):
        return None
    while sets:
        words = {w for own in sets for w in own}
        best = max(words, key=lambda w: (sum(w in own for own in sets) if len(w) > 2 else 0, len(w), w))
        out.append(best)
        sets = [own for own in sets if best not in own]
    return tuple(out)
