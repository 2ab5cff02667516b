"""Signature rules of license names and notices, over lower-case words put together with one space.

A line is: label, priority, keywords, and behind `::` a regular expression for whole words.  The rule is tried where one
of its keywords (words; commas mean or) is among a text's words.  Braces in a label take the expression's groups.
Priorities: 5 tags that name a license, 4 sentences of its own text, 3 name and version, 2 name, 1 a hint that there
is a license.  LIC, VER, FSF and LATER stand for the spellings below.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SPELLINGS = {
    "LIC": "licen[cs]e",
    "VER": "(?:(?:v|ver|version|release) )?v?",
    "FSF": "(?: as published by the free software foundation)?",
    "LATER": "(?: of the licen[cs]e)?(?: or(?: at your option| alternatively)?(?: any)? (?:later|newer|higher)(?: versions?)?| and (?:later|newer|above)| plus)",
}

RULES = """
gpl-1.0 3 gnu,gpl,gplv1 :: (?:gplv1|(?:gnu )?gpl VER1|gnu general public LIC(?: gpl)?FSF VER1)(?: 0)?
gpl-2.0 3 gnu,gpl,gplv2 :: (?:gplv2|(?:gnu )?gpl VER2|gnu general public LIC(?: gpl)?FSF VER2)(?: 0)?
gpl-3.0 3 gnu,gpl,gplv3 :: (?:gplv3|(?:gnu )?gpl VER3|gnu general public LIC(?: gpl)?FSF VER3)(?: 0)?
gpl-1.0-or-later 4 gnu,gpl,gplv1 :: (?:gplv1|(?:gnu )?gpl VER1|gnu general public LIC(?: gpl)?FSF(?: either)? VER1)(?: 0)?LATER
gpl-2.0-or-later 4 gnu,gpl,gplv2 :: (?:gplv2|(?:gnu )?gpl VER2|gnu general public LIC(?: gpl)?FSF(?: either)? VER2)(?: 0)?LATER
gpl-3.0-or-later 4 gnu,gpl,gplv3 :: (?:gplv3|(?:gnu )?gpl VER3|gnu general public LIC(?: gpl)?FSF(?: either)? VER3)(?: 0)?LATER
gpl-2.0-only 4 gnu,gpl :: (?:gnu general public LIC|(?:gnu )?gpl) VER2(?: 0)? only
gpl-3.0-only 4 gnu,gpl :: (?:gnu general public LIC|(?:gnu )?gpl) VER3(?: 0)? only
gpl-2.0-only 4 gnu,general :: version 2 of the gnu general public LICFSF(?! or)
gpl-3.0-only 4 gnu,general :: version 3 of the gnu general public LICFSF(?! or)
gpl-2.0 4 gpl :: gnu general public LIC version 2 june 1991
gpl-3.0 4 general :: gnu general public LIC version 3 29 june 2007
gpl-2.0 4 copyleft,programs :: the licen[cs]es for most software are designed to take away your freedom to share and change it
gpl-3.0 4 copyleft :: the gnu general public LIC is a free copyleft LIC for software and other kinds of works
gpl 2 gpl :: (?:gnu )?gpl(?: licen[cs]ed?)?
gpl 2 general :: (?:gnu )?general public LIC
gpl 4 redistribute :: this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl 4 warranty,program :: you should have received a copy of the gnu general public LIC along with this (?:program|software|file|package)
gpl-2.0-with-classpath-exception 4 classpath :: gpl(?:v2| VER2)?(?: 0)? with(?: the)? classpath exception
gpl-2.0-with-classpath-exception 4 classpath :: subject to the classpath exception as provided
gpl-2.0-with-gcc-exception 4 gcc :: gcc runtime library exception
gpl-2.0-with-font-exception 4 font :: gpl(?:v2| VER2)?(?: 0)? with(?: the)? font exception
gpl-2.0-with-autoconf-exception 4 autoconf :: autoconf(?: configure script)? exception
gpl-2.0-with-bison-exception 4 bison :: special exception you may create a larger work that contains part or all of the bison parser skeleton
linux-syscall-note 4 syscall :: linux syscall note
lgpl-2.0 3 lgpl,lgplv2,library :: (?:lgplv2 0|(?:gnu )?lgpl VER2 0|gnu (?:library|lesser) general public LIC(?: lgpl)?FSF VER2(?: 0)?)(?! 1)
lgpl-2.1 3 lgpl,lgplv2,lesser :: (?:lgplv2 1|(?:gnu )?lgpl VER2 1|(?:gnu )?lesser general public LIC(?: lgpl)?FSF VER2 1)
lgpl-3.0 3 lgpl,lgplv3,lesser :: (?:lgplv3|(?:gnu )?lgpl VER3|(?:gnu )?lesser general public LIC(?: lgpl)?FSF VER3)(?: 0)?
lgpl-2.0-or-later 4 lgpl,lgplv2,library :: (?:lgplv2|(?:gnu )?lgpl VER2|gnu (?:library|lesser) general public LIC(?: lgpl)?FSF(?: either)? VER2)(?: 0)?LATER
lgpl-2.1-or-later 4 lgpl,lgplv2,lesser :: (?:lgplv2 1|(?:gnu )?lgpl VER2 1|(?:gnu )?lesser general public LIC(?: lgpl)?FSF(?: either)? VER2 1)LATER
lgpl-3.0-or-later 4 lgpl,lgplv3,lesser :: (?:lgplv3|(?:gnu )?lgpl VER3|(?:gnu )?lesser general public LIC(?: lgpl)?FSF(?: either)? VER3)(?: 0)?LATER
lgpl 2 lgpl :: (?:gnu )?lgpl(?: licen[cs]ed?)?
lgpl 2 lesser :: (?:gnu )?lesser general public LIC
lgpl 2 library :: gnu library general public LIC
lgpl 4 library :: this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC
agpl-1.0 3 affero :: affero(?: inc)? general public LIC VER1(?: 0)?
agpl-3.0 3 agpl,agplv3,affero :: (?:agplv3|(?:gnu )?agpl VER3|(?:gnu )?affero general public LIC(?: agpl)?FSF VER3)(?: 0)?
agpl-3.0-or-later 4 agpl,agplv3,affero :: (?:agplv3|(?:gnu )?agpl VER3|(?:gnu )?affero general public LIC(?: agpl)?FSF(?: either)? VER3)(?: 0)?LATER
agpl-3.0-only 4 agpl,affero :: (?:(?:gnu )?agpl|(?:gnu )?affero general public LIC) VER3(?: 0)? only
agpl 2 agpl :: (?:gnu )?agpl(?: licen[cs]ed?)?
agpl 2 affero :: (?:gnu )?affero general public LIC
gfdl-1.1 3 gfdl,documentation :: (?:gfdl|gnu free documentation LIC)(?: gfdl)? VER1 1
gfdl-1.2 3 gfdl,documentation :: (?:gfdl|gnu free documentation LIC)(?: gfdl)? VER1 2
gfdl-1.3 3 gfdl,documentation :: (?:gfdl|gnu free documentation LIC)(?: gfdl)? VER1 3
gfdl-1.{0}-or-later 4 documentation :: gnu free documentation LIC version 1 ([123])LATER
gfdl 2 gfdl,documentation :: (?:gfdl|(?:gnu )?free documentation LIC)
gfdl 4 invariant :: with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
apache-1.0 3 apache :: apache(?: software)? LIC VER1 0
apache-1.1 3 apache :: apache(?: software)? LIC VER1 1
apache-2.0 3 apache :: (?:the )?apache(?: software)? LIC(?: asl)? VER2(?: 0)?
apache-2.0 3 apache :: apache (?:v2|2)(?: 0)?(?: LIC)?
apache-2.0 3 asl :: asl VER2(?: 0)?
apache-2.0 4 apache :: licen[cs]ed under the apache LIC version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2.0 4 apache :: https? www apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?
apache-2.0 4 apache :: apache LIC version 2 0 january 2004
apache-2.0 4 contributor :: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent LIC
apache-2.0 4 conditions :: unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis
apache 2 apache :: apache(?: software)? LIC
apache 2 apache :: apache licen[cs]ed
mit 4 granted :: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 4 substantial :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 4 dealings :: arising from out of or in connection with the software or the use or other dealings in the software
mit 3 license,licence :: (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit LIC
mit 2 license,licence,licensed,licenced,licenses :: (?:the )?mit licen[cs]e[ds]?
mit 2 expat :: expat LIC
mit 2 x11 :: (?:mit x11|x11)(?: style)? LIC
mit-0 3 attribution :: mit no attribution(?: LIC)?
mit-0 3 license,licence :: mit 0 LIC
mit-like 2 license,licence :: mit (?:style|like|type) LIC
bsd-2-clause 3 bsd :: (?:simplified|freebsd|2 clause|two clause) bsd(?: LIC)?
bsd-2-clause 3 bsd :: bsd (?:2|two) clause(?: simplified)?(?: LIC)?
bsd-3-clause 3 bsd :: (?:modified|new|revised|3 clause|three clause) bsd(?: LIC)?
bsd-3-clause 3 bsd :: bsd (?:3|three) clause(?: new| revised)?(?: LIC)?
bsd-3-clause-clear 3 bsd :: (?:clear bsd LIC|bsd 3 clause clear)
bsd-4-clause 3 bsd :: (?:original|old|4 clause|four clause) bsd(?: LIC)?
bsd-4-clause 3 bsd :: bsd (?:4|four) clause(?: original| old)?(?: LIC)?
bsd-1-clause 3 bsd :: bsd (?:1|one) clause(?: LIC)?
0bsd 3 bsd,0bsd :: (?:0bsd|bsd (?:0|zero) clause|zero clause bsd)(?: LIC)?
bsd 2 bsd :: bsd (?:style |like |type )?licen[cs]e[ds]?
bsd 2 berkeley :: berkeley software distribution LIC
bsd 4 redistribution :: redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause 4 endorse :: (?:neither )?the names? of .{0,120}? (?:may not|may|nor the names of its contributors may) be used to endorse or promote products derived from this software
bsd-4-clause 4 advertising :: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-patent 3 patent :: bsd(?: 2 clause)? plus patent(?: LIC)?
isc 3 isc :: isc LIC
isc 4 granted :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib 2 zlib :: zlib(?: libpng)? LIC
zlib 4 misrepresented :: the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng 2 libpng :: libpng LIC(?: version 2)?
boost-1.0 3 boost :: boost software LIC(?: version)? v?1(?: 0)?
boost-1.0 3 bsl :: bsl 1 0
boost-1.0 2 boost :: boost(?: software)? LIC
unlicense 2 unlicense :: (?:the )?unlicense
unlicense 4 encumbered :: this is free and unencumbered software released into the public domain
unlicense 4 unencumbered :: this is free and unencumbered software released into the public domain
wtfpl 2 wtfpl :: wtfpl(?: VER2)?
wtfpl 2 fuck :: do what the fuck you want to public LIC
beerware 2 beerware,beer :: beer ?ware(?: LIC)?
public-domain 2 domain :: (?:released|placed|dedicated|donated)(?: in)?(?: to| into) the public domain
public-domain 1 domain :: (?:is|are) in the public domain
cc0-1.0 3 cc0 :: cc0(?: 1 0)?(?: universal)?
cc0-1.0 3 creative :: creative commons (?:zero|cc0|public domain dedication)(?: v?1 0)?(?: universal)?
cc-pdm-1.0 3 mark :: (?:creative commons )?public domain mark(?: 1 0)?
cc-by-{0}.{1} 3 cc :: cc by ([1-4]) ([05])
cc-by-sa-{0}.{1} 3 cc :: cc by sa ([1-4]) ([05])
cc-by-nc-{0}.{1} 3 cc :: cc by nc ([1-4]) ([05])
cc-by-nd-{0}.{1} 3 cc :: cc by nd ([1-4]) ([05])
cc-by-nc-sa-{0}.{1} 3 cc :: cc by nc sa ([1-4]) ([05])
cc-by-nc-nd-{0}.{1} 3 cc :: cc by nc nd ([1-4]) ([05])
cc-by 2 cc :: cc by(?: LIC)?
cc-by-sa 2 cc :: cc by sa(?: LIC)?
cc-by-nc 2 cc :: cc by nc(?: LIC)?
cc-by-nd 2 cc :: cc by nd(?: LIC)?
cc-by-nc-sa 2 cc :: cc by nc sa(?: LIC)?
cc-by-nc-nd 2 cc :: cc by nc nd(?: LIC)?
cc-by-{0}.{1} 3 creative :: creative commons attribution VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by-sa-{0}.{1} 3 creative :: creative commons attribution share ?alike VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by-nc-{0}.{1} 3 creative :: creative commons attribution non ?commercial VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by-nd-{0}.{1} 3 creative :: creative commons attribution no ?deriv(?:ative)?s?(?: works)? VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by-nc-sa-{0}.{1} 3 creative :: creative commons attribution non ?commercial share ?alike VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by-nc-nd-{0}.{1} 3 creative :: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? VER([1-4]) ([05])(?: international| unported| generic)?(?: LIC)?
cc-by 2 creative :: creative commons attribution(?: LIC)?
cc-by-sa 2 creative :: creative commons attribution share ?alike(?: LIC)?
cc-by-nc 2 creative :: creative commons attribution non ?commercial(?: LIC)?
cc-by-nd 2 creative :: creative commons attribution no ?deriv(?:ative)?s?(?: LIC)?
cc-by-nc-sa 2 creative :: creative commons attribution non ?commercial share ?alike(?: LIC)?
cc-by-nc-nd 2 creative :: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: LIC)?
cc-{0}-{1}.{2} 4 creativecommons :: creativecommons org licen[cs]es (by|by sa|by nc|by nd|by nc sa|by nc nd) ([1-4]) ([05])
cc0-1.0 4 creativecommons :: creativecommons org publicdomain zero 1 0
cc-pdm-1.0 4 creativecommons :: creativecommons org publicdomain mark 1 0
cc 2 creative :: creative commons licen[cs]e[ds]?
cc-sampling-plus 2 sampling :: creative commons sampling plus
mpl-1.0 3 mpl,mozilla :: (?:mpl|mozilla public LIC)(?: mpl)? VER1 0
mpl-1.1 3 mpl,mozilla :: (?:mpl|mozilla public LIC)(?: mpl)? VER1 1
mpl-2.0 3 mpl,mozilla :: (?:mpl|mozilla public LIC)(?: mpl)? VER2(?: 0)?
mpl-2.0 4 mozilla :: this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-2.0-no-copyleft-exception 4 incompatible :: this source code form is incompatible with secondary licen[cs]es
mpl 2 mozilla :: mozilla public LIC
mpl-tri 3 mpl :: mpl(?: 1 1)? gpl(?: 2 0)? lgpl(?: 2 1)?
epl-1.0 3 epl,eclipse :: (?:epl|eclipse public LIC)(?: epl)? VER1(?: 0)?
epl-2.0 3 epl,eclipse :: (?:epl|eclipse public LIC)(?: epl)? VER2(?: 0)?
epl 2 eclipse :: eclipse public LIC
edl-1.0 3 eclipse :: eclipse distribution LIC(?: VER1(?: 0)?)?
cddl-1.0 3 cddl,distribution :: (?:cddl|common development and distribution LIC)(?: cddl)? VER1 0
cddl-1.1 3 cddl,distribution :: (?:cddl|common development and distribution LIC)(?: cddl)? VER1 1
cddl 2 cddl,distribution :: (?:cddl|common development and distribution LIC)
cpl-1.0 3 cpl,common :: (?:cpl|common public LIC)(?: cpl)? VER1(?: 0)?
cpl 2 common :: common public LIC
ipl-1.0 2 ibm :: ibm public LIC(?: VER1(?: 0)?)?
eupl-1.1 3 eupl,european :: (?:eupl|european union public licen[cs]e)(?: eupl)? VER1 1
eupl-1.2 3 eupl,european :: (?:eupl|european union public licen[cs]e)(?: eupl)? VER1 2
eupl 2 eupl,european :: (?:eupl|european union public licen[cs]e)
artistic-1.0 3 artistic :: artistic LIC VER1(?: 0)?
artistic-2.0 3 artistic :: artistic LIC VER2(?: 0)?
artistic 2 artistic :: (?:perl )?artistic LIC
perl 2 perl :: same terms as perl(?: 5)?(?: itself)?
python-2.0 3 python :: python(?: software foundation)? LIC VER2(?: 0)?
python 2 python :: python(?: software foundation)? LIC
psf-2.0 2 psf :: psf(?: LIC)?(?: VER2(?: 0)?)?
ruby 2 ruby :: (?:the )?ruby s? ?LIC
php-3.0 3 php :: php LIC VER3 0
php-3.01 3 php :: php LIC VER3 01
php 2 php :: php LIC
zend-2.0 2 zend :: zend(?: engine)? LIC(?: VER2(?: 0)?)?
openssl 2 openssl :: openssl(?: ssleay)?(?: dual)? LIC
ssleay 2 ssleay :: (?:original )?ssleay LIC
postgresql 2 postgresql :: postgresql LIC
vim 2 vim :: vim LIC
tcl 2 tcl :: tcl(?: tk)? LIC
curl 2 curl :: curl LIC
icu 2 icu :: icu LIC
unicode 2 unicode :: unicode(?: inc)? LIC(?: agreement)?
x11 2 x11 :: x(?:11)? consortium LIC
xfree86-1.1 2 xfree86 :: xfree86 LIC(?: VER1 1)?
w3c 2 w3c :: w3c(?: software)?(?: notice and)?(?: document)? LIC
ofl-1.1 3 ofl,sil :: (?:sil )?(?:ofl|open font LIC)(?: ofl)? VER1 1
ofl 2 sil,ofl :: (?:sil (?:ofl|open font LIC)|ofl)
ofl 4 font :: this font software is licen[cs]ed under the sil open font LIC
lppl-1.3c 3 lppl,latex :: (?:lppl|latex project public LIC)(?: lppl)? VER1 3c?
lppl 2 lppl,latex :: (?:lppl|latex project public LIC)
ms-pl 2 microsoft :: microsoft public LIC(?: ms pl)?
ms-rl 2 microsoft :: microsoft reciprocal LIC(?: ms rl)?
ms-pl 2 pl :: ms pl
ms-rl 2 rl :: ms rl
apsl-2.0 2 apple,apsl :: (?:apsl|apple public source LIC)(?: VER2(?: 0)?)?
osl-3.0 3 osl,open :: (?:osl|open software LIC)(?: osl)? VER3(?: 0)?
osl 2 software :: open software LIC
afl-3.0 3 afl,academic :: (?:afl|academic free LIC)(?: afl)? VER3(?: 0)?
afl 2 academic :: academic free LIC
ecl-2.0 2 educational :: educational community LIC(?: VER2(?: 0)?)?
upl-1.0 2 upl,universal :: (?:upl|universal permissive LIC)(?: VER1(?: 0)?)?
ncsa 2 ncsa,illinois :: (?:university of illinois(?: ncsa)?(?: open source)? LIC|ncsa(?: open source)? LIC)
bsl-1.1 3 business :: business source LIC(?: VER1 1)?
sspl-1.0 3 sspl,server :: (?:sspl|server side public LIC)(?: sspl)?(?: VER1)?
elastic-2.0 3 elastic :: elastic LIC(?: VER2(?: 0)?)?
commons-clause 3 commons :: commons clause(?: LIC condition)?
polyform-noncommercial 3 polyform :: polyform non ?commercial LIC
polyform-small-business 3 polyform :: polyform small business LIC
polyform-strict 3 polyform :: polyform strict LIC
blueoak-1.0.0 3 oak :: blue oak model LIC(?: VER1 0 0)?
mulan-psl-2.0 3 mulan :: mulan (?:psl|permissive software LIC)(?: VER2)?
odbl-1.0 3 odbl,database :: (?:odbl|open (?:data commons open )?database LIC)(?: odbl)?(?: VER1(?: 0)?)?
odc-by-1.0 3 odc,commons :: (?:odc by|open data commons attribution LIC)(?: VER1(?: 0)?)?
pddl-1.0 3 pddl,domain :: (?:pddl|public domain dedication and LIC)(?: VER1(?: 0)?)?
cdla-permissive 3 cdla,community :: (?:cdla|community data LIC agreement) permissive(?: VER[12](?: 0)?)?
cdla-sharing 3 cdla,community :: (?:cdla|community data LIC agreement) sharing(?: VER1(?: 0)?)?
ogl-uk-{0}.0 3 ogl,government :: (?:ogl|open government licen[cs]e) VER([123])(?: 0)?
ogl-uk 2 government :: open government licen[cs]e
etalab-2.0 3 etalab,ouverte :: (?:licence ouverte|etalab)(?: open LIC)?(?: VER2(?: 0)?)?
dl-de-by-2.0 3 datenlizenz :: datenlizenz deutschland(?: namensnennung)?(?: VER2(?: 0)?)?
openrail 3 openrail :: (?:creativeml )?open ?rail m?(?: LIC)?
bigscience-rail-1.0 3 rail :: (?:bigscience )?rail LIC(?: VER1(?: 0)?)?
cecill-2.1 3 cecill :: cecill(?: LIC)?(?: VER2(?: 1)?)
cecill-b 3 cecill :: cecill b(?: LIC)?
cecill-c 3 cecill :: cecill c(?: LIC)?
cecill 2 cecill :: cecill(?: LIC)?
qpl-1.0 2 qpl :: (?:qpl|q public LIC)(?: VER1(?: 0)?)?
sleepycat 2 sleepycat :: sleepycat(?: public)? LIC
intel 2 intel :: intel(?: open source| simplified software) LIC
nvidia 2 nvidia :: nvidia(?: software)? LIC(?: agreement)?
jsonlicense 2 json :: json LIC
jsonlicense 4 evil :: the software shall be used for good not evil
hpnd 2 permission :: historical permission notice and disclaimer
catosl-1.1 2 computer :: computer associates trusted open source LIC
nasa-1.3 2 nasa :: nasa open source agreement(?: VER1 3)?
ntp 2 ntp :: ntp LIC
naumen 2 naumen :: naumen public LIC
nokia 2 nokia :: nokia open source LIC
sissl 2 sissl,industry :: (?:sissl|sun industry standards source LIC)
watcom-1.0 2 watcom :: sybase open watcom public LIC
zpl-2.1 2 zope,zpl :: (?:zpl|zope public LIC)(?: VER2(?: [01])?)?
ijg 2 jpeg :: independent jpeg group(?: s)? LIC
imagemagick 2 imagemagick :: imagemagick LIC
freetype 2 freetype :: freetype(?: project)? LIC
bitstream-vera 2 vera :: bitstream vera(?: fonts?)? (?:LIC|copyright)
opl-1.0 2 publication :: open publication LIC(?: VER1(?: 0)?)?
fal-1.3 2 art,libre :: (?:free art LIC|licence art libre)(?: VER1 3)?
aladdin 2 aladdin :: aladdin free public LIC
spdx-{0} 5 spdx :: spdx licen[cs]e identifier (apache 2 0|mit|isc|zlib|unlicense|bsd [234] clause|gpl [123] 0(?: only| or later)?|lgpl [23] [01](?: only| or later)?|agpl 3 0(?: only| or later)?|mpl [12] [01]|epl [12] 0|cc0 1 0|cc by(?: nc)?(?: sa| nd)? [1-4] [05])
spdx-tag 1 spdx :: spdx licen[cs]e identifier [0-9a-z]+
all-rights-reserved 1 rights,reserved :: all rights reserved
copyright 1 copyright :: copyright c? ?(?:19|20)[0-9][0-9]
proprietary 2 proprietary,confidential :: (?:proprietary and confidential|confidential and proprietary)
proprietary 2 license,licence :: (?:commercial|proprietary) LIC(?: agreement)?
proprietary 2 prohibited :: unauthori[sz]ed (?:copying|reproduction|distribution|use) .{0,60}?is (?:strictly )?prohibited
non-commercial 2 commercial,noncommercial :: for (?:non ?commercial|academic|personal|research) use only
free-to-use 1 free :: free (?:for|to) (?:any )?(?:use|redistribution)
eula 2 eula,end :: (?:eula|end user LIC agreement)
as-is 1 warranty :: provided as is without (?:any )?(?:express or implied )?warranty
license-reference 1 license,licence :: see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: txt| md)?(?: file)? for (?:the )?(?:full |more )?(?:details|terms|information|text|licen[cs]e)
license-reference 1 license,licence :: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?[^ ]+(?: [^ ]+){0,4}? LIC
license-reference 1 licensed,licenced :: this (?:work|software|file|project|document|package|library) is licen[cs]ed under
"""


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]


def parse(rules: str) -> list[Rule]:
    """The rules in order; patterns are of bytes and hold whole words."""
    out = []
    for line in filter(None, map(str.strip, rules.splitlines())):
        head, _, pattern = line.partition(" :: ")
        label, priority, keywords = head.split()
        for name, spelling in SPELLINGS.items():
            pattern = pattern.replace(name, spelling)
        out.append(Rule(label, int(priority), tuple(keywords.split(",")), re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    return out
