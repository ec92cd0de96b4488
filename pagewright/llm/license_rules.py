r"""The signatures of the licence scan, written by hand: label and pattern over lower-cased words joined by single spaces.

Sections by priority: the wording of the licences themselves, notices by which a work is put under one, names with a
version, bare names and identifiers. ``V`` stands for the ways to write a version before its number.
"""

# Wording of published licences and notices.
WORDING = r"""
mit: permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit: to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit: in no event shall the authors or copyright holders be liable for any claim damages or other liability
isc: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc: the author disclaims all warranties with regard to this software
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice this list of conditions
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause: neither the name of .{0,60} nor the names of its contributors may be used to endorse or promote
bsd-3-clause: the names of its contributors may not be used to endorse or promote products derived from this software
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd: this software is provided by the copyright holders and contributors as is and any express or implied warranties
apache: you may not use this (?:file|software|work) except in compliance with the license
apache: you may obtain a copy of the license at http www apache org licenses license 2 0
apache: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache: this product includes software developed (?:by|at) the apache software foundation
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: you should have received a copy of the gnu general public license along with this program
gpl: the licenses for most software are designed to take away your freedom to share and change it
gpl: either version [123] of the license or at your option any later version
gpl: the gnu general public license is a free copyleft license for software and other kinds of works
lgpl: you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl: you can redistribute it and or modify it under the terms of the gnu library general public license
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license along with this
lgpl: this library is distributed in the hope that it will be useful but without any warranty
agpl: you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl: you should have received a copy of the gnu affero general public license along with this
agpl: if you modify the program your modified version must prominently offer all users interacting with it remotely
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections no front cover texts and no back cover texts
mpl: this source code form is subject to the terms of the mozilla public license
mpl: if a copy of the mpl was not distributed with this file you can obtain one at
mpl: the contents of this file are subject to the mozilla public license
epl: this program and the accompanying materials are made available under the terms of the eclipse public license
epl: the accompanying program is provided under the terms of this eclipse public license
edl: this program and the accompanying materials are made available under the terms of the eclipse distribution license
cddl: the contents of this file are subject to the terms of the common development and distribution license
cpl: the accompanying program is provided under the terms of this common public license
eupl: licensed under the eupl version 1 [0-2] or as soon they will be approved by the european commission
artistic: the intent of this document is to state the conditions under which a package may be copied
artistic: this license establishes the terms under which a given free software package may be copied modified distributed
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib: this notice may not be removed or altered from any source distribution
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
wtfpl: you just do what the fuck you want to
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
cc0: the person who associated a work with this deed has dedicated the work to the public domain
cc0: to the extent possible under law .{0,80} has waived all copyright and related or neighboring rights
cc-by: you are free to share copy and redistribute the material in any medium or format
cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc: you may not use the material for commercial purposes
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
ofl: this font software is licensed under the sil open font license
ofl: neither the font software nor any of its individual components in original or modified versions may be sold by itself
psf: psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: redistributions of any form whatsoever must retain the following acknowledgment
php: the name php must not be used to endorse or promote products derived from this software
w3c: permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ncsa: developed by .{0,80} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
x11: except as contained in this notice the name of .{0,60} shall not be used in advertising
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
beerware: as long as you retain this notice you can do whatever you want with this stuff
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer
json: the software shall be used for good not evil
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code
sspl: if you make the functionality of the program or a modified version available to third parties as a service
busl: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic: you may not provide the software to third parties as a hosted or managed service
odbl: the licensor grants to you a worldwide royalty free non exclusive terminable .{0,40} license to use the database
ogl: you are free to copy publish distribute and transmit the information
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
"""

NOTICES = r"""
apache: licensed under the apache license
apache: licensed to the apache software foundation asf under one or more contributor license agreements
apache: (?:released|distributed|available|published) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e
apache: under the apache licen[cs]e
mit: licensed under (?:the )?(?:terms of the )?mit licen[cs]e
mit: (?:released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
mit: use of this source code is governed by an mit style license
mit: licensed under mit
bsd: use of this source code is governed by a bsd style license
bsd: licensed under (?:the )?(?:terms of the )?(?:new |modified |simplified |revised )?bsd licen[cs]e
bsd: (?:released|distributed|available|published) under (?:the )?(?:terms of the )?bsd licen[cs]e
isc: (?:licensed|released|distributed) under (?:the )?isc licen[cs]e
gpl: licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl: licensed under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e
gpl: (?:released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl: under the terms of the gnu general public licen[cs]e
gpl: subject to the (?:terms of the )?gnu general public licen[cs]e
lgpl: licensed under (?:the )?(?:terms of the )?(?:gnu )?lgpl
lgpl: under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl: (?:licensed|released|distributed) under (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
agpl: licensed under (?:the )?(?:terms of the )?(?:gnu )?agpl
agpl: under the terms of the gnu affero general public licen[cs]e
agpl: (?:licensed|released|distributed) under (?:the )?(?:gnu )?affero general public licen[cs]e
gfdl: under the terms of the gnu free documentation licen[cs]e
gfdl: (?:licensed|released|available) under (?:the )?(?:gnu )?(?:gfdl|free documentation licen[cs]e)
mpl: subject to the (?:terms of the )?mozilla public licen[cs]e
mpl: (?:licensed|released|distributed) under (?:the )?(?:mpl|mozilla public licen[cs]e)
epl: (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:epl|eclipse public licen[cs]e)
eupl: (?:licensed|released|distributed) under (?:the )?(?:eupl|european union public licen[cs]e)
cddl: (?:licensed|released|distributed) under (?:the )?(?:cddl|common development and distribution licen[cs]e)
artistic: (?:licensed|released|distributed) under (?:the )?(?:perl )?artistic licen[cs]e
artistic: this is free software you can redistribute it and or modify it under the same terms as perl itself
zlib: (?:licensed|released|distributed) under (?:the )?zlib(?: libpng)? licen[cs]e
bsl-1.0: distributed under the boost software licen[cs]e
unlicense: (?:licensed|released|distributed) under (?:the )?unlicense
wtfpl: (?:licensed|released|distributed) under (?:the )?wtfpl
psf: (?:licensed|released|distributed) under (?:the )?(?:python software foundation|psf) licen[cs]e
ofl: (?:licensed|released|available) under (?:the )?(?:sil )?open font licen[cs]e
odbl: (?:licensed|available) under (?:the )?(?:odbl|open (?:data commons )?(?:open )?database licen[cs]e)
ogl: (?:licensed|available) under (?:the )?(?:terms of the )?open government licen[cs]e
ogl: contains public sector information licensed under the open government licen[cs]e
cc-by: licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[cs]e
cc-by-sa: licensed under (?:a |the )?creative commons attribution share ?alike
cc-by-nc: licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? licen[cs]e
cc-by-nd: licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa: licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike
cc-by-nc-nd: licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by: (?:licensed|released|published|available) under (?:a )?cc by
cc-by-sa: (?:licensed|released|published|available) under (?:a )?cc by sa
cc-by-nc: (?:licensed|released|published|available) under (?:a )?cc by nc
cc-by-nd: (?:licensed|released|published|available) under (?:a )?cc by nd
cc-by-nc-sa: (?:licensed|released|published|available) under (?:a )?cc by nc sa
cc-by-nc-nd: (?:licensed|released|published|available) under (?:a )?cc by nc nd
cc0: (?:licensed|released|available|dedicated) (?:under|with) (?:a |the )?(?:creative commons )?cc0
public-domain: (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain: this (?:work|file|code|software|image|document|text) is in the public domain
public-domain: no copyright is claimed
proprietary: all rights reserved
proprietary: proprietary and confidential
proprietary: unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|material|document) .{0,40}is (?:strictly )?prohibited
proprietary: no part of this (?:publication|book|document|work) may be reproduced
proprietary: this software is the confidential and proprietary information of
proprietary: may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior |express )*written (?:permission|consent)
commons-clause: the software is provided to you by the licensor under the license as defined below subject to the following condition
sspl: (?:licensed|released|available) under (?:the )?server side public licen[cs]e
busl: (?:licensed|released|available) under (?:the )?business source licen[cs]e
elastic: (?:licensed|released|available) under (?:the )?elastic licen[cs]e
dual: (?:dual|double) licensed under
"""

VERSIONS = r"""
gpl: (?:gnu )?gpl V?1(?: 0)?
gpl: (?:gnu )?gpl V?2(?: 0)?(?: only| or later)?
gpl: (?:gnu )?gpl V?3(?: 0)?(?: only| or later)?
gpl: gplv1(?: only| or later)?
gpl: gplv2(?: only| or later)?
gpl: gplv3(?: only| or later)?
gpl: general public licen[cs]e V?2(?: 0)?(?: or later| or any later version)?
gpl: general public licen[cs]e V?3(?: 0)?(?: or later| or any later version)?
lgpl: (?:gnu )?lgpl V?2(?: [01])?(?: only| or later)?
lgpl: (?:gnu )?lgpl V?3(?: 0)?(?: only| or later)?
lgpl: lgplv2(?: 1)?(?: only| or later)?
lgpl: lgplv3(?: only| or later)?
lgpl: (?:lesser|library) general public licen[cs]e V?(?:2|2 0|2 1|3|3 0)(?: or later)?
agpl: (?:gnu )?agpl V?[13](?: 0)?(?: only| or later)?
agpl: agplv3(?: only| or later)?
agpl: affero general public licen[cs]e V?3(?: 0)?(?: or later)?
gfdl: free documentation licen[cs]e V?1 [123](?: or later)?
gfdl: gfdl V?1 [123]
apache: apache licen[cs]e V?2(?: 0)?
apache: apache licen[cs]e V?1 1
apache: apache software licen[cs]e V?1 [01]
apache: apache 2 0
apache: apache V?2(?: 0)? licen[cs]e
mpl: mozilla public licen[cs]e V?2 0
mpl: mozilla public licen[cs]e V?1 [01]
mpl: mpl V?(?:1 0|1 1|2 0)
epl: eclipse public licen[cs]e V?[12] 0
epl: epl V?[12] 0
eupl: european union public licen[cs]e V?1 [012]
eupl: eupl V?1 [012]
cddl: common development and distribution licen[cs]e V?1 [01]
cddl: cddl V?1 [01]
cpl: common public licen[cs]e V?1 0
artistic: artistic licen[cs]e V?[12] 0
bsl-1.0: boost software licen[cs]e V?1 0
psf: python software foundation licen[cs]e V?2
ofl: open font licen[cs]e V?1 [01]
odbl: open database licen[cs]e V?1 0
ogl: open government licen[cs]e V?[123] 0
wtfpl: wtfpl V?[12]
bsd-2-clause: bsd 2 clause
bsd-3-clause: bsd 3 clause
bsd-4-clause: bsd 4 clause
bsd-2-clause: (?:two|2) clause bsd
bsd-3-clause: (?:three|3) clause bsd
bsd-4-clause: (?:four|4) clause bsd
cc-by: cc by V?[1-4] [05]
cc-by-sa: cc by sa V?[1-4] [05]
cc-by-nc: cc by nc V?[1-4] [05]
cc-by-nd: cc by nd V?[1-4] [05]
cc-by-nc-sa: cc by nc sa V?[1-4] [05]
cc-by-nc-nd: cc by nc nd V?[1-4] [05]
cc-by: creative commons attribution [1-4] [05]
cc-by-sa: creative commons attribution share ?alike [1-4] [05]
cc-by-nc: creative commons attribution non ?commercial [1-4] [05]
cc0: cc0 1 0(?: universal)?
cc0: cc 0 1 0(?: universal)?
cc-by: creativecommons org licenses by [1-4] [05]
cc-by-sa: creativecommons org licenses by sa [1-4] [05]
cc-by-nc: creativecommons org licenses by nc [1-4] [05]
cc-by-nd: creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa: creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd: creativecommons org licenses by nc nd [1-4] [05]
cc0: creativecommons org publicdomain zero 1 0
gpl: www gnu org licenses gpl
lgpl: www gnu org licenses lgpl
agpl: www gnu org licenses agpl
gfdl: www gnu org licenses fdl
mit: opensource org licenses mit
bsd: opensource org licenses bsd
"""

NAMES = r"""
gpl: gnu general public licen[cs]e
gpl: gnu gpl
gpl: spdx license identifier gpl
lgpl: gnu (?:lesser|library) general public licen[cs]e
lgpl: gnu lgpl
lgpl: spdx license identifier lgpl
agpl: gnu affero general public licen[cs]e
agpl: spdx license identifier agpl
gfdl: gnu free documentation licen[cs]e
apache: apache (?:software )?licen[cs]e
apache: spdx license identifier apache
mit: mit licen[cs]e
mit: mit x11 licen[cs]e
mit: expat licen[cs]e
mit: spdx license identifier mit
isc: isc licen[cs]e
isc: spdx license identifier isc
bsd: bsd licen[cs]e
bsd: bsd style licen[cs]e
bsd-3-clause: (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause: simplified bsd licen[cs]e
bsd-2-clause: freebsd licen[cs]e
bsd: spdx license identifier bsd
mpl: mozilla public licen[cs]e
mpl: spdx license identifier mpl
epl: eclipse public licen[cs]e
edl: eclipse distribution licen[cs]e
eupl: european union public licen[cs]e
cddl: common development and distribution licen[cs]e
cpl: common public licen[cs]e
artistic: artistic licen[cs]e
zlib: zlib(?: libpng)? licen[cs]e
bsl-1.0: boost software licen[cs]e
unlicense: spdx license identifier unlicense
psf: python software foundation licen[cs]e
ofl: (?:sil )?open font licen[cs]e
odbl: (?:odc )?open database licen[cs]e
odc-by: open data commons attribution licen[cs]e
pddl: open data commons public domain dedication
ogl: open government licen[cs]e
ms-pl: microsoft public licen[cs]e
ms-rl: microsoft reciprocal licen[cs]e
cc-by: creative commons attribution
cc-by-sa: creative commons attribution share ?alike
cc-by-nc: creative commons attribution non ?commercial
cc-by-nd: creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by: cc by
cc-by-sa: cc by sa
cc-by-nc: cc by nc
cc-by-nd: cc by nd
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd: cc by nc nd
cc0: creative commons zero
openssl: openssl licen[cs]e
php: php licen[cs]e
ncsa: (?:university of illinois )?ncsa (?:open source )?licen[cs]e
postgresql: postgresql licen[cs]e
vim: vim licen[cs]e
ruby: ruby licen[cs]e
sspl: server side public licen[cs]e
busl: business source licen[cs]e
elastic: elastic licen[cs]e
cecill: cecill(?: b| c)?(?: licen[cs]e)?
opl: open publication licen[cs]e
osl: open software licen[cs]e
afl: academic free licen[cs]e
ipl: ibm public licen[cs]e
qpl: q public licen[cs]e
npl: netscape public licen[cs]e
"""

#: By priority, the highest first.
SECTIONS = ((4, WORDING), (3, NOTICES), (2, VERSIONS), (1, NAMES))
VERSION = r"(?:version |v )?v?"
