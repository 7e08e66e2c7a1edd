"""The license signatures, one a line: label, priority, keywords (one of these words stands in any match), expression.

Texts are lower-case words joined by single spaces: "GPL-3.0" reads ``gpl 3 0`` and "GPLv3" reads ``gplv3``.  An expression matches
whole words; LICENSE stands for both spellings, UNDER for the ways to say that terms apply, GRANTED for those that only licenses have,
which names that are other words too need, VER for what may stand before a number, LATER for "or any later version", and
MARK for a colon or an equals sign in the text between two words.
Priorities: 100 identifiers, 90 grants with a version, 85 texts and headers, 80 grants, 60 names with a version,
50 names before "license", 30 and less hints.  A bare name, as prose has it, is no signature.
"""

#: The signatures.
SIGNATURES = r"""
mit 100 spdx spdx LICENSE identifier mit
mit 85 permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 70 permission permission is hereby granted free of charge to any person obtaining a copy
mit 85 notice the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 85 expat expat LICENSE
mit 80 mit UNDER(?:an? )?mit(?: x11| expat| style)? LICENSE
mit 80 mit GRANTED(?:an? )?mit
mit 50 mit mit(?: style| x11| expat)? LICENSE
mit 40 mit LICENSE (?:type |is |is the )mit
mit 40 mit LICENSE MARKmit
mit 40 mit mit licen[sc]ed
mit-0 100 spdx spdx LICENSE identifier mit 0
mit-0 60 mit mit no attribution(?: LICENSE)?
mit-advertising 85 advertising permission is hereby granted (?:.{0,200} )?advertising publicity pertaining to distribution of the software
x11 100 spdx spdx LICENSE identifier x11
x11 50 x11 x11 LICENSE
x11 85 consortium except as contained in this notice the name of the x consortium shall not be used in advertising
isc 100 spdx spdx LICENSE identifier isc
isc 85 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 70 permission permission to use copy modify and or distribute this software for any purpose
isc 80 isc UNDER(?:an? )?isc LICENSE
isc 80 isc GRANTED(?:an? )?isc
isc 50 isc isc LICENSE
0bsd 100 spdx spdx LICENSE identifier 0bsd
0bsd 60 0bsd 0bsd(?: LICENSE)
0bsd 60 zero (?:bsd zero clause|zero clause bsd) LICENSE
apache-1.0 100 spdx spdx LICENSE identifier apache 1 0
apache-1.0 85 apache this product includes software developed by the apache group for use in the apache http server project
apache-1.1 100 spdx spdx LICENSE identifier apache 1 1
apache-1.1 85 apache this product includes software developed by the apache software foundation http www apache org
apache-1.1 60 apache apache(?: software)? LICENSE (?:version |v )?1 1
apache-2.0 100 spdx spdx LICENSE identifier apache 2 0
apache-2.0 90 apache UNDERapache(?: software)? LICENSE (?:version |v ?)?2(?: 0)?
apache-2.0 85 apache you may not use this file except in compliance with the LICENSE you may obtain a copy of the LICENSE at https? www apache org licenses LICENSE 2 0
apache-2.0 70 apache www apache org licenses LICENSE 2 0(?: txt| html)?
apache-2.0 85 perpetual each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LICENSE
apache-2.0 70 apache terms and conditions for use reproduction and distribution (?:.{0,80} )?apache
apache-2.0 60 apache|apachev2 apache(?: software)? LICENSE (?:version |v ?)?2(?: 0)?
apache-2.0 60 apache apache v ?2(?: 0)?
apache-2.0 60 apache apache 2 0
apache-2.0 60 apache2|apachev2|asl2|aslv2 (?:apachev?2|aslv?2)(?: 0)?(?: LICENSE)?
apache 80 apache UNDERapache(?: software)? LICENSE
apache 50 apache apache(?: software)? LICENSE
apache 40 apache LICENSE (?:is |type )?apache
apache 40 apache apache licen[sc]ed
gpl-1 100 spdx spdx LICENSE identifier gpl 1 0(?: only| or later)?
gpl-1 60 gpl|gplv1|gpl1 gplVER1(?: 0)?
gpl-1 60 general general public LICENSE (?:version |v )1(?: 0)?
gpl-2 100 spdx spdx LICENSE identifier gpl 2 0(?: only| or later)?
gpl-2 90 general UNDER(?:gnu )?general public LICENSE (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?: of the LICENSE)?(?: LATER)?
gpl-2 90 gpl|gplv2|gpl2 UNDER(?:gnu )?gplVER2(?: 0)?(?: LATER)?
gpl-2 60 gpl|gplv2|gpl2 (?:gnu )?gplVER2(?: 0)?(?: LATER)?
gpl-2 60 general (?:gnu )?general public LICENSE (?:version |v ?)2(?: 0)?(?: LATER)?
gpl-2 85 foundation version 2 june 1991 copyright c 1989 1991 free software foundation
gpl-2 70 modify you can redistribute it and or modify it under the terms of the gnu general public LICENSE as published by the free software foundation either version 2 of the LICENSE
gpl-2 40 gpl|gplv2|gpl2 LICENSE (?:is )?(?:gnu )?gplVER2
gpl-2-classpath 90 classpath gplVER2(?: 0)? with(?: the)? classpath exception
gpl-2-classpath 60 classpath with(?: the)?(?: gnu)? classpath exception
gpl-3 100 spdx spdx LICENSE identifier gpl 3 0(?: only| or later)?
gpl-3 90 general UNDER(?:gnu )?general public LICENSE (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the LICENSE)?(?: LATER)?
gpl-3 90 gpl|gplv3|gpl3 UNDER(?:gnu )?gplVER3(?: 0)?(?: LATER)?
gpl-3 60 gpl|gplv3|gpl3 (?:gnu )?gplVER3(?: 0)?(?: LATER)?
gpl-3 60 general (?:gnu )?general public LICENSE (?:version |v ?)3(?: 0)?(?: LATER)?
gpl-3 85 foundation version 3 29 june 2007 copyright c 2007 free software foundation
gpl-3 70 modify you can redistribute it and or modify it under the terms of the gnu general public LICENSE as published by the free software foundation either version 3 of the LICENSE
gpl-3 40 gpl|gplv3|gpl3 LICENSE (?:is )?(?:gnu )?gplVER3
gpl 85 copyleft the gnu general public LICENSE is a free copyleft LICENSE for software
gpl 80 gpl UNDER(?:gnu )?gpl(?: LICENSE)?
gpl 80 general UNDER(?:gnu )?general public LICENSE
gpl 70 redistribute you can redistribute it and or modify it under the terms of the gnu general public LICENSE
gpl 60 received you should have received a copy of the gnu general public LICENSE along with
gpl 50 gpl (?:gnu )?gpl LICENSE
gpl 50 general gnu general public LICENSE
gpl 50 gpl gnu gpl
gpl 40 gpl LICENSE (?:is |type )?(?:gnu )?gpl
gpl 40 gpl gpl(?: ed| licen[sc]ed)
lgpl-2.0 100 spdx spdx LICENSE identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 60 library (?:gnu )?library general public LICENSE(?: (?:version |v ?)2(?: 0)?)?(?: LATER)?
lgpl-2.0 60 lgpl|lgplv2|lgpl2 (?:gnu )?lgplVER2(?: 0)?(?: LATER)?
lgpl-2.1 100 spdx spdx LICENSE identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 90 lesser UNDER(?:gnu )?lesser general public LICENSE (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the LICENSE)?(?: LATER)?
lgpl-2.1 90 lgpl|lgplv2|lgpl2 UNDER(?:gnu )?lgplVER2 1(?: LATER)?
lgpl-2.1 60 lgpl|lgplv2|lgpl2 (?:gnu )?lgplVER2 1(?: LATER)?
lgpl-2.1 60 lesser (?:gnu )?lesser general public LICENSE (?:version |v ?)?2 1(?: LATER)?
lgpl-2.1 85 foundation version 2 1 february 1999 copyright c 1991 1999 free software foundation
lgpl-3 100 spdx spdx LICENSE identifier lgpl 3 0(?: only| or later)?
lgpl-3 90 lesser UNDER(?:gnu )?lesser general public LICENSE (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the LICENSE)?(?: LATER)?
lgpl-3 90 lgpl|lgplv3|lgpl3 UNDER(?:gnu )?lgplVER3(?: 0)?(?: LATER)?
lgpl-3 60 lgpl|lgplv3|lgpl3 (?:gnu )?lgplVER3(?: 0)?(?: LATER)?
lgpl-3 60 lesser (?:gnu )?lesser general public LICENSE (?:version |v ?)?3(?: 0)?(?: LATER)?
lgpl 80 lesser UNDER(?:gnu )?lesser general public LICENSE
lgpl 80 lgpl UNDER(?:gnu )?lgpl(?: LICENSE)?
lgpl 60 received you should have received a copy of the gnu lesser general public LICENSE along with
lgpl 50 lesser (?:gnu )?lesser general public LICENSE
lgpl 50 lgpl (?:gnu lgpl|lgpl LICENSE|lgpl licen[sc]ed)
agpl-1 100 spdx spdx LICENSE identifier agpl 1 0(?: only| or later)?
agpl-3 100 spdx spdx LICENSE identifier agpl 3 0(?: only| or later)?
agpl-3 90 agpl|agplv3|agpl3 UNDER(?:gnu )?agplVER3(?: 0)?(?: LATER)?
agpl-3 90 affero UNDER(?:gnu )?affero general public LICENSE (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the LICENSE)?(?: LATER)?
agpl-3 60 agpl|agplv3|agpl3 (?:gnu )?agplVER3(?: 0)?(?: LATER)?
agpl-3 60 affero (?:gnu )?affero general public LICENSE (?:version |v ?)3(?: 0)?(?: LATER)?
agpl-3 85 foundation version 3 19 november 2007 copyright c 2007 free software foundation
agpl 80 agpl UNDER(?:gnu )?agpl(?: LICENSE)?
agpl 60 received you should have received a copy of the gnu affero general public LICENSE along with
agpl 50 affero (?:gnu )?affero general public LICENSE
agpl 50 agpl (?:gnu agpl|agpl LICENSE|agpl licen[sc]ed)
gfdl-1.2 100 spdx spdx LICENSE identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 100 spdx spdx LICENSE identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 60 documentation gnu free documentation LICENSE (?:version |v ?)1 2(?: LATER)?
gfdl-1.3 60 documentation gnu free documentation LICENSE (?:version |v ?)1 3(?: LATER)?
gfdl 85 invariant with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gfdl 50 documentation (?:gnu )?free documentation LICENSE
bsd-1-clause 100 spdx spdx LICENSE identifier bsd 1 clause
bsd-2-clause 100 spdx spdx LICENSE identifier bsd 2 clause
bsd-2-clause 60 bsd|freebsd (?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause|bsd two clause)(?: style)? LICENSE
bsd-2-clause 60 bsd UNDER(?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause)
bsd-3-clause 100 spdx spdx LICENSE identifier bsd 3 clause
bsd-3-clause 60 bsd (?:new bsd|revised bsd|modified bsd|3 clause bsd|three clause bsd|bsd 3 clause|bsd three clause)(?: style)?(?: LICENSE)?
bsd-3-clause 85 endorse neither the name of .{1,120} nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause 100 spdx spdx LICENSE identifier bsd 4 clause
bsd-4-clause 60 bsd (?:original bsd|old bsd|4 clause bsd|four clause bsd|bsd 4 clause)(?: style)?(?: LICENSE)?
bsd-4-clause 85 acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd 85 redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 70 redistribution redistribution and use in source and binary forms with or without modification
bsd 70 disclaimer redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 80 bsd UNDER(?:an? )?bsd(?: style)? LICENSE
bsd 80 bsd GRANTED(?:an? )?bsd
bsd 50 bsd bsd(?: style)? LICENSE
bsd 40 bsd LICENSE (?:is |type )?bsd
bsd 40 bsd bsd licen[sc]ed
mpl-1.0 100 spdx spdx LICENSE identifier mpl 1 0
mpl-1.1 100 spdx spdx LICENSE identifier mpl 1 1
mpl-1.1 60 mpl|mplv1|mpl1 mplVER1 1
mpl-1.1 60 mozilla mozilla public LICENSE (?:version |v ?)?1 1
mpl-2.0 100 spdx spdx LICENSE identifier mpl 2 0
mpl-2.0 90 mozilla UNDERmozilla public LICENSE (?:version |v ?)?2(?: 0)?
mpl-2.0 90 mozilla this source code form is subject to the terms of the mozilla public LICENSE v 2 0
mpl-2.0 60 mpl|mplv2|mpl2 mplVER2(?: 0)?
mpl-2.0 60 mozilla mozilla public LICENSE (?:version |v ?)?2(?: 0)?
mpl-2.0 70 mozilla if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl 50 mozilla mozilla public LICENSE
mpl 50 mpl mpl (?:LICENSE|licen[sc]ed)
epl-1.0 100 spdx spdx LICENSE identifier epl 1 0
epl-1.0 60 eclipse eclipse public LICENSE (?:version |v ?)?1(?: 0)?
epl-1.0 60 epl|eplv1|epl1 eplVER1(?: 0)?
epl-2.0 100 spdx spdx LICENSE identifier epl 2 0
epl-2.0 60 eclipse eclipse public LICENSE (?:version |v ?)?2(?: 0)?
epl-2.0 60 epl|eplv2|epl2 eplVER2(?: 0)?
epl 70 eclipse this program and the accompanying materials are made available under the terms of the eclipse public LICENSE
epl 50 eclipse eclipse public LICENSE
edl 60 eclipse eclipse distribution LICENSE(?: (?:version |v ?)?1 0)?
cddl-1.0 100 spdx spdx LICENSE identifier cddl 1 0
cddl-1.0 60 cddl|cddlv1|cddl1 cddlVER1 0
cddl-1.1 100 spdx spdx LICENSE identifier cddl 1 1
cddl-1.1 60 cddl|cddlv1|cddl1 cddlVER1 1
cddl 50 distribution common development and distribution LICENSE
cddl 50 cddl cddl LICENSE
cpl-1.0 60 common common public LICENSE(?: (?:version |v ?)?1 0)?
cpl-1.0 100 spdx spdx LICENSE identifier cpl 1 0
ipl-1.0 60 ibm ibm public LICENSE(?: (?:version |v ?)?1 0)?
eupl-1.1 60 eupl|euplv1|eupl1 euplVER1 1
eupl-1.2 60 eupl|euplv1|eupl1 euplVER1 2
eupl-1.2 100 spdx spdx LICENSE identifier eupl 1 2
eupl 50 european european union public licen[sc]e
cecill-2.1 60 cecill|cecillv2|cecill2 cecillVER2 1
cecill 50 cecill cecill(?: b| c)?(?: free software)? LICENSE
artistic-1.0 60 artistic (?:perl )?artistic LICENSE (?:version |v ?)?1(?: 0)?
artistic-2.0 60 artistic artistic LICENSE (?:version |v ?)?2(?: 0)?
artistic-2.0 100 spdx spdx LICENSE identifier artistic 2 0
artistic 70 perl (?:redistribute it and or modify it )?under the same terms as perl itself
artistic 50 artistic (?:perl )?artistic LICENSE
zlib 100 spdx spdx LICENSE identifier zlib
zlib 85 misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 70 misrepresented the origin of this software must not be misrepresented
zlib 70 altered altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 50 zlib zlib(?: libpng)? LICENSE
libpng 50 libpng libpng LICENSE
bsl-1.0 100 spdx spdx LICENSE identifier bsl 1 0
bsl-1.0 90 boost UNDERboost software LICENSE(?: (?:version |v ?)?1 0)?
bsl-1.0 60 boost boost software LICENSE(?: (?:version |v ?)?1 0)?
busl-1.1 100 spdx spdx LICENSE identifier busl 1 1
busl-1.1 60 business business source LICENSE(?: (?:version |v ?)?1 1)?
sspl-1 100 spdx spdx LICENSE identifier sspl 1 0
sspl-1 60 server server side public LICENSE(?: (?:version |v ?)?1(?: 0)?)?
elastic-2.0 100 spdx spdx LICENSE identifier elastic 2 0
elastic-2.0 60 elastic elastic LICENSE (?:version |v ?)?2(?: 0)?
elastic 50 elastic elastic LICENSE
commons-clause 60 commons commons clause LICENSE(?: condition)?(?: v ?1 0)?
polyform 60 polyform polyform (?:noncommercial|perimeter|shield|small business|strict|internal use) LICENSE(?: 1 0 0)?
prosperity 60 prosperity prosperity public LICENSE(?: 3 0 0)?
unlicense 100 spdx spdx LICENSE identifier unlicense
unlicense 85 unencumbered this is free and unencumbered software released into the public domain
unlicense 80 unlicense UNDERunlicense
unlicense 50 unlicense (?:the unlicense|unlicense org)
wtfpl 100 spdx spdx LICENSE identifier wtfpl
wtfpl 60 wtfpl wtfpl(?: LICENSE| v ?2| version 2)
wtfpl 60 fuck do what the fuck you want to public LICENSE
beerware 60 beer|beerware beer ?ware LICENSE(?: revision 42)?
cc0-1.0 100 spdx spdx LICENSE identifier cc0 1 0
cc0-1.0 60 cc0 cc0(?: 1 0)(?: universal)?
cc0 60 cc0 cc0 (?:LICENSE|universal|public domain dedication|waiver)
cc0 80 cc0 UNDERcc0
cc-by-2.0 60 cc cc by 2 0
cc-by-2.5 60 cc cc by 2 5
cc-by-3.0 60 cc cc by 3 0
cc-by-4.0 60 cc cc by 4 0
cc-by-sa-2.0 60 cc cc by sa 2 0
cc-by-sa-2.5 60 cc cc by sa 2 5
cc-by-sa-3.0 60 cc cc by sa 3 0
cc-by-sa-4.0 60 cc cc by sa 4 0
cc-by-nd-3.0 60 cc cc by nd 3 0
cc-by-nd-4.0 60 cc cc by nd 4 0
cc-by-nc-3.0 60 cc cc by nc 3 0
cc-by-nc-4.0 60 cc cc by nc 4 0
cc-by-nc-sa-3.0 60 cc cc by nc sa 3 0
cc-by-nc-sa-4.0 60 cc cc by nc sa 4 0
cc-by-nc-nd-3.0 60 cc cc by nc nd 3 0
cc-by-nc-nd-4.0 60 cc cc by nc nd 4 0
cc-by-3.0 60 creative creative commons attribution 3 0(?: unported| international)?(?: LICENSE)?
cc-by-4.0 60 creative creative commons attribution 4 0(?: international)?(?: LICENSE)?
cc-by-sa-3.0 60 creative creative commons attribution share ?alike 3 0(?: unported)?(?: LICENSE)?
cc-by-sa-4.0 60 creative creative commons attribution share ?alike 4 0(?: international)?(?: LICENSE)?
cc-by-nc-4.0 60 creative creative commons attribution non ?commercial 4 0(?: international)?(?: LICENSE)?
cc-by-nc-sa-4.0 60 creative creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: LICENSE)?
cc-by-nc-nd-4.0 60 creative creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: LICENSE)?
cc-by-4.0 70 creativecommons creativecommons org licenses by 4 0
cc-by-sa-4.0 70 creativecommons creativecommons org licenses by sa 4 0
cc-by-sa-3.0 70 creativecommons creativecommons org licenses by sa 3 0
cc-by-nc-sa-4.0 70 creativecommons creativecommons org licenses by nc sa 4 0
cc0-1.0 70 creativecommons creativecommons org publicdomain zero 1 0
cc-by-nc-sa 50 cc (?:UNDERcc by nc sa|cc by nc sa LICENSE)
cc-by-nc 50 cc (?:UNDERcc by nc|cc by nc LICENSE)
cc-by-sa 50 cc (?:UNDERcc by sa|cc by sa LICENSE)
cc-by 50 cc (?:UNDERcc by|cc by LICENSE)
cc-by-sa 50 creative creative commons attribution share ?alike(?: LICENSE)?
cc-by-nc 50 creative creative commons attribution non ?commercial(?: LICENSE)?
cc-by 50 creative creative commons attribution LICENSE
cc 40 creative creative commons LICENSE
cc 40 creative UNDER(?:an? )?creative commons
odbl-1.0 60 odbl odbl(?: v ?1 0| 1 0| LICENSE)
odbl-1.0 60 database open (?:data commons open )?database LICENSE
odc-by-1.0 60 commons open data commons attribution LICENSE
pddl-1.0 60 pddl pddl(?: v ?1 0| 1 0| LICENSE)
cdla-permissive-2.0 60 cdla cdla permissive (?:v ?)?(?:1|2) 0
ofl-1.1 100 spdx spdx LICENSE identifier ofl 1 1
ofl-1.1 60 font (?:sil )?open font LICENSE(?: (?:version |v ?)?1 1)?
ofl-1.1 85 font this font software is licen[sc]ed under the sil open font LICENSE
psf-2.0 60 python|psf (?:python software foundation|psf) LICENSE(?: (?:version |v ?)?2)?
psf-2.0 100 spdx spdx LICENSE identifier (?:psf|python) 2 0(?: 1)?
postgresql 100 spdx spdx LICENSE identifier postgresql
postgresql 50 postgresql postgresql LICENSE
ncsa 60 ncsa (?:university of illinois )?ncsa(?: open source)? LICENSE
ncsa 100 spdx spdx LICENSE identifier ncsa
upl-1.0 60 universal universal permissive LICENSE(?: (?:version |v ?)?1 0)?
openssl 50 openssl openssl LICENSE
openssl 85 openssl this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 60 php php LICENSE (?:version |v ?)?3 01
php-3.0 60 php php LICENSE (?:version |v ?)?3 0
php 50 php php LICENSE
ruby 50 ruby ruby LICENSE
vim 50 vim vim LICENSE
tcl 50 tcl tcl tk LICENSE
curl 50 curl curl LICENSE
imagemagick 50 imagemagick imagemagick LICENSE
freetype 50 freetype (?:freetype|freetype project) LICENSE
ms-pl 60 microsoft microsoft public LICENSE
ms-rl 60 microsoft microsoft reciprocal LICENSE
ms-eula 50 microsoft microsoft software LICENSE terms
osl-3.0 60 open open software LICENSE (?:version |v ?)?3 0
osl 50 open open software LICENSE
afl-3.0 60 academic academic free LICENSE (?:version |v ?)?3 0
afl 50 academic academic free LICENSE
qpl-1.0 60 q q public LICENSE(?: (?:version |v ?)?1 0)?
spl-1.0 50 sun sun public LICENSE
npl-1.1 50 netscape netscape public LICENSE
apsl-2.0 50 apple apple public source LICENSE
rpl-1.5 50 reciprocal reciprocal public LICENSE
json 70 evil the software shall be used for good not evil
mulan-2.0 50 mulan mulan (?:psl|permissive software LICENSE)(?: v ?2)?
blueoak-1.0 60 blue blue oak model LICENSE(?: 1 0 0)?
hippocratic 50 hippocratic hippocratic LICENSE
openrail 60 openrail|rail (?:bigscience |creativeml )?(?:big ?science )?open ?rail(?: m| s)?(?: LICENSE)?
llama-community 60 llama (?:meta )?llama (?:2|3|3 1|3 2|3 3|4) community LICENSE(?: agreement)?
gemma 60 gemma gemma terms of use
public-domain 60 domain (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain 60 domain public domain (?:dedication|mark|notice)
public-domain 50 rights|copyright no (?:rights reserved|known copyright restrictions)
proprietary 60 proprietary (?:proprietary and confidential|confidential and proprietary)
proprietary 60 unauthorized unauthorized (?:copying|reproduction|distribution) of this (?:file|software|material|document)(?: via any medium)? is (?:strictly )?prohibited
proprietary 40 proprietary proprietary LICENSE
proprietary 40 agreement end user LICENSE agreement(?: eula)?
proprietary 30 rights all rights reserved
warranty 20 warranty the software is provided as is without warranty of any kind
"""
