"""The signature rules of the license scan, written by hand, in their order.

Every rule is (label, keyword, expression) over the normalised words of a text: A-Z
lower-cased, single spaces between words, points and hyphens gone (``GPL-2.0`` is
``gpl 2 0``). The keyword begins a word in everything that the expression can match. No
keyword begins another one, and no expression matches without bound.
"""

from __future__ import annotations

#: Machine-readable identifiers.
TAGS = [
    ("mit", "spdx", r"spdx license identifier mit"),
    ("mit-0", "spdx", r"spdx license identifier mit 0"),
    ("x11", "spdx", r"spdx license identifier x11"),
    ("isc", "spdx", r"spdx license identifier isc"),
    ("0bsd", "spdx", r"spdx license identifier 0bsd"),
    ("bsd-1-clause", "spdx", r"spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause"),
    ("apache-1.1", "spdx", r"spdx license identifier apache 1 1"),
    ("apache-2.0", "spdx", r"spdx license identifier apache 2 0(?: with llvm exception)?"),
    ("gpl-1.0", "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?(?: with [a-z]+ [a-z]+(?: note)?)?"),
    ("gpl-3.0", "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl", "spdx", r"spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "spdx", r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", "spdx", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", "spdx", r"spdx license identifier epl 1 0"),
    ("epl-2.0", "spdx", r"spdx license identifier epl 2 0"),
    ("cddl-1.0", "spdx", r"spdx license identifier cddl 1 [01]"),
    ("eupl-1.1", "spdx", r"spdx license identifier eupl 1 1"),
    ("eupl-1.2", "spdx", r"spdx license identifier eupl 1 2"),
    ("cc0-1.0", "spdx", r"spdx license identifier cc0 1 0"),
    ("cc-by", "spdx", r"spdx license identifier cc by [1234] [05]"),
    ("cc-by-sa", "spdx", r"spdx license identifier cc by sa [1234] [05]"),
    ("cc-by-nd", "spdx", r"spdx license identifier cc by nd [1234] [05]"),
    ("cc-by-nc", "spdx", r"spdx license identifier cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "spdx", r"spdx license identifier cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "spdx", r"spdx license identifier cc by nc nd [1234] [05]"),
    ("artistic-1.0", "spdx", r"spdx license identifier artistic 1 0(?: perl)?"),
    ("artistic-2.0", "spdx", r"spdx license identifier artistic 2 0"),
    ("bsl-1.0", "spdx", r"spdx license identifier bsl 1 0"),
    ("zlib", "spdx", r"spdx license identifier zlib(?: acknowledgement)?"),
    ("unlicense", "spdx", r"spdx license identifier unlicense"),
    ("wtfpl", "spdx", r"spdx license identifier wtfpl"),
    ("ofl-1.1", "spdx", r"spdx license identifier ofl 1 [01]"),
    ("ms-pl", "spdx", r"spdx license identifier ms pl"),
    ("psf-2.0", "spdx", r"spdx license identifier (?:psf|python) 2 0"),
    ("postgresql", "spdx", r"spdx license identifier postgresql"),
    ("openssl", "spdx", r"spdx license identifier openssl"),
    ("ncsa", "spdx", r"spdx license identifier ncsa"),
    ("busl-1.1", "spdx", r"spdx license identifier busl 1 1"),
    ("odbl-1.0", "spdx", r"spdx license identifier odbl 1 0"),
    ("proprietary", "spdx", r"spdx license identifier licenseref [a-z]+"),
]

#: Sentences of the licenses themselves and of the headers that they ask for.
TEXTS = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person(?: obtaining a copy)?(?: of this software)?"),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "restriction", r"to deal in the software without restriction"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("bsl-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification are permitted)?"),
    ("bsd", "redistribution", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribution", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "contributors", r"neither the name of (?:[^ ]+ ){1,10}nor the names of its contributors"),
    ("bsd-4-clause", "mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software"),
    ("apache-2.0", "apache", r"apache license version 2 0 january 2004"),
    ("apache-2.0", "licen", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "gnu", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "licen", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software"),
    ("gpl-2.0", "gnu", r"gnu general public license version 2 june 1991"),
    ("gpl-2.0", "gnu", r"under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl-3.0", "gnu", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "licen", r"published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "licen", r"published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "gnu", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "gnu", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "gnu", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gfdl", "gnu", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license version 1 [01]"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cddl-1.0", "licen", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e"),
    ("zlib", "plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("cc0-1.0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "domain", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "redistribute", r"copy and redistribute the material in any medium or format"),
    ("ofl-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", r"the font software may be sold as part of a larger software package"),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "licen", r"this license establishes the terms under which a given free software package may be copied"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("psf-2.0", "python", r"psf is making python available to licensee on an as is basis"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e"),
    ("w3c", "w3c", r"this work is being provided by the copyright holders under the w3c"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("commons-clause", "licen", r"the software is provided to you by the licensor under the license as defined below subject to the following condition|commons clause license condition"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "licen", r"make non production use of the licensed work"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) license 1 0 [01]"),
    ("proprietary", "unauthori", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
]

#: Statements that something is under a license; what stands before the name is written out once.
_U = r"(?:(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed) (?:to you )?(?:by|under) |under )(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_V = r"(?: licen[cs]e)?(?: version)? ?v? ?"
NOTICES = [
    ("mit", "mit", _U + r"mit(?: x11| expat)?(?: licen[cs]e)?"),
    ("mit-0", "mit", _U + r"mit (?:0|no attribution)(?: licen[cs]e)?"),
    ("x11", "x11", _U + r"x11(?: licen[cs]e)?"),
    ("isc", "isc", _U + r"isc(?: licen[cs]e)?"),
    ("0bsd", "0bsd", _U + r"0bsd(?: licen[cs]e)?"),
    ("0bsd", "bsd", _U + r"(?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", _U + r"bsd(?: style)?(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", _U + r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", _U + r"freebsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", _U + r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", _U + r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?"),
    ("apache", "apache", _U + r"apache(?: software)?(?: licen[cs]e)?"),
    ("apache-1.1", "apache", _U + r"apache(?: software)?" + _V + r"1 1"),
    ("apache-2.0", "apache", _U + r"apache(?: software)?" + _V + r"2(?: 0)?(?: licen[cs]e)?"),
    ("gpl", "gpl", _U + r"(?:gnu )?gpl(?: licen[cs]e)?"),
    ("gpl", "licen", _U + r"(?:gnu )?general public licen[cs]e"),
    ("gpl-1.0", "gpl", _U + r"(?:gnu )?gpl" + _V + r"1(?: 0)?"),
    ("gpl-2.0", "gpl", _U + r"(?:gnu )?gpl" + _V + r"2(?: 0)?(?: or later)?"),
    ("gpl-2.0", "licen", _U + r"(?:gnu )?general public licen[cs]e(?: version)? ?v? ?2(?: 0)?(?: or later)?"),
    ("gpl-3.0", "gpl", _U + r"(?:gnu )?gpl" + _V + r"3(?: 0)?(?: or later)?"),
    ("gpl-3.0", "licen", _U + r"(?:gnu )?general public licen[cs]e(?: version)? ?v? ?3(?: 0)?(?: or later)?"),
    ("lgpl", "lgpl", _U + r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("lgpl", "licen", _U + r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "licen", _U + r"(?:gnu )?library general public licen[cs]e(?: version)? ?v? ?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", _U + r"(?:gnu )?lgpl" + _V + r"2 1(?: or later)?"),
    ("lgpl-2.1", "licen", _U + r"(?:gnu )?lesser general public licen[cs]e(?: version)? ?v? ?2 1(?: or later)?"),
    ("lgpl-3.0", "lgpl", _U + r"(?:gnu )?lgpl" + _V + r"3(?: 0)?(?: or later)?"),
    ("lgpl-3.0", "licen", _U + r"(?:gnu )?lesser general public licen[cs]e(?: version)? ?v? ?3(?: 0)?(?: or later)?"),
    ("agpl-3.0", "agpl", _U + r"(?:gnu )?agpl(?:" + _V + r"3(?: 0)?)?(?: or later)?"),
    ("agpl-3.0", "affero", _U + r"(?:gnu )?affero general public licen[cs]e(?: version 3(?: 0)?)?"),
    ("gfdl", "licen", _U + r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("mpl-1.1", "mpl", _U + r"mpl" + _V + r"1 1"),
    ("mpl-2.0", "mpl", _U + r"mpl" + _V + r"2(?: 0)?"),
    ("mpl-1.1", "mozilla", _U + r"mozilla public" + _V + r"1 1"),
    ("mpl-2.0", "mozilla", _U + r"mozilla public" + _V + r"2(?: 0)?"),
    ("epl-1.0", "epl", _U + r"epl" + _V + r"1(?: 0)?"),
    ("epl-2.0", "epl", _U + r"epl" + _V + r"2(?: 0)?"),
    ("epl-1.0", "eclipse", _U + r"eclipse public" + _V + r"1(?: 0)?"),
    ("epl-2.0", "eclipse", _U + r"eclipse public" + _V + r"2(?: 0)?"),
    ("cddl-1.0", "cddl", _U + r"cddl(?: licen[cs]e)?(?: v?1 [01])?"),
    ("eupl-1.2", "eupl", _U + r"eupl(?: version| v)?(?: ?1 [012])?"),
    ("eupl-1.2", "licen", _U + r"european union public licen[cs]e(?: v ?1 [012])?"),
    ("cc0-1.0", "cc", _U + r"cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?"),
    ("cc0-1.0", "creative", _U + r"creative commons (?:zero|cc0)(?: 1 0)?(?: licen[cs]e)?"),
    ("cc-by", "cc", _U + r"(?:a )?cc by(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by-sa", "cc", _U + r"(?:a )?cc by sa(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by-nd", "cc", _U + r"(?:a )?cc by nd(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by-nc", "cc", _U + r"(?:a )?cc by nc(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "cc", _U + r"(?:a )?cc by nc sa(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "cc", _U + r"(?:a )?cc by nc nd(?: [1234] [05])?(?: licen[cs]e)?"),
    ("cc-by", "creative", _U + r"(?:a )?creative commons attribution(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative", _U + r"(?:a )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("cc-by-nd", "creative", _U + r"(?:a )?creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative", _U + r"(?:a )?creative commons attribution non ?commercial(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "creative", _U + r"(?:a )?creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "creative", _U + r"(?:a )?creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| generic| unported)?(?: licen[cs]e)?"),
    ("creative-commons", "creative", _U + r"(?:a )?creative commons(?: licen[cs]e)?"),
    ("artistic-1.0", "artistic", _U + r"artistic" + _V + r"1(?: 0)?"),
    ("artistic-2.0", "artistic", _U + r"artistic" + _V + r"2(?: 0)?"),
    ("perl", "perl", r"under the same terms as perl itself"),
    ("zlib", "zlib", _U + r"zlib(?: libpng)?(?: licen[cs]e)?"),
    ("unlicense", "unlicense", _U + r"unlicense"),
    ("wtfpl", "wtfpl", _U + r"wtfpl"),
    ("bsl-1.0", "boost", _U + r"boost(?: software)?(?: licen[cs]e)?(?: version)?(?: ?v?1 0)?"),
    ("ms-pl", "microsoft", _U + r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", _U + r"microsoft reciprocal licen[cs]e"),
    ("psf-2.0", "python", _U + r"python(?: software foundation)? licen[cs]e"),
    ("php-3.01", "php", _U + r"php licen[cs]e"),
    ("ruby", "ruby", _U + r"ruby(?: s)? licen[cs]e|under the same terms as ruby"),
    ("openssl", "openssl", _U + r"openssl licen[cs]e"),
    ("postgresql", "postgresql", _U + r"postgresql licen[cs]e"),
    ("upl-1.0", "licen", _U + r"universal permissive licen[cs]e"),
    ("ofl-1.1", "ofl", _U + r"(?:sil )?ofl"),
    ("ofl-1.1", "licen", _U + r"(?:sil )?open font licen[cs]e"),
    ("odbl-1.0", "licen", _U + r"(?:odc )?open database licen[cs]e"),
    ("odbl-1.0", "odbl", _U + r"odbl"),
    ("odc-by", "licen", _U + r"open data commons attribution licen[cs]e"),
    ("pddl", "licen", _U + r"(?:odc )?public domain dedication(?: and)? licen[cs]e"),
    ("cecill", "cecill", _U + r"cecill(?: [bc])?(?: licen[cs]e)?"),
    ("sspl-1.0", "sspl", _U + r"sspl"),
    ("sspl-1.0", "licen", _U + r"server side public licen[cs]e"),
    ("busl-1.1", "licen", _U + r"business source licen[cs]e"),
    ("elastic-2.0", "elastic", _U + r"elastic licen[cs]e(?: 2 0)?"),
    ("json", "json", _U + r"json licen[cs]e"),
    ("mulanpsl-2.0", "mulan", _U + r"mulan(?: permissive software|psl)(?: licen[cs]e)?"),
    ("blueoak-1.0.0", "licen", _U + r"blue oak model licen[cs]e"),
    ("polyform", "polyform", _U + r"polyform (?:noncommercial|small business|strict)(?: licen[cs]e)?"),
    ("proprietary", "licen", _U + r"(?:a )?commercial licen[cs]e"),
]

#: Fields of package descriptions: ``License: MIT``, ``licensed GPLv2``.
FIELDS = [
    ("mit", "licen", r"licen[cs]ed? (?:is )?mit"),
    ("isc", "licen", r"licen[cs]ed? (?:is )?isc"),
    ("0bsd", "licen", r"licen[cs]ed? (?:is )?0bsd"),
    ("bsd", "licen", r"licen[cs]ed? (?:is )?bsd"),
    ("bsd-2-clause", "licen", r"licen[cs]ed? (?:is )?bsd 2(?: clause)?"),
    ("bsd-3-clause", "licen", r"licen[cs]ed? (?:is )?bsd 3(?: clause)?"),
    ("apache-2.0", "licen", r"licen[cs]ed? (?:is )?apache(?: licen[cs]e)?(?: version)? ?v?2(?: 0)?"),
    ("gpl", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?gpl"),
    ("gpl-2.0", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?lgpl"),
    ("lgpl-2.1", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3.0", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "licen", r"licen[cs]ed? (?:is )?(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("mpl-2.0", "licen", r"licen[cs]ed? (?:is )?mpl ?v?2(?: 0)?"),
    ("epl-2.0", "licen", r"licen[cs]ed? (?:is )?epl ?v?2(?: 0)?"),
    ("cc0-1.0", "licen", r"licen[cs]ed? (?:is )?cc0(?: 1 0)?"),
    ("cc-by", "licen", r"licen[cs]ed? (?:is )?cc by(?: [1234] [05])?"),
    ("cc-by-sa", "licen", r"licen[cs]ed? (?:is )?cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", "licen", r"licen[cs]ed? (?:is )?cc by nc(?: [1234] [05])?"),
    ("artistic-2.0", "licen", r"licen[cs]ed? (?:is )?artistic 2(?: 0)?"),
    ("zlib", "licen", r"licen[cs]ed? (?:is )?zlib"),
    ("unlicense", "licen", r"licen[cs]ed? (?:is )?unlicense"),
    ("psf-2.0", "licen", r"licen[cs]ed? (?:is )?psf"),
    ("public-domain", "licen", r"licen[cs]ed? (?:is )?public domain"),
    ("proprietary", "licen", r"licen[cs]ed? (?:is )?(?:proprietary|commercial|unlicensed)"),
]

#: Names that stand alone.
NAMES = [
    ("mit", "mit", r"mit(?: x11| expat)? licen[cs]e[ds]?"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e[ds]?"),
    ("isc", "isc", r"isc licen[cs]e[ds]?"),
    ("0bsd", "0bsd", r"0bsd licen[cs]e[ds]?"),
    ("0bsd", "bsd", r"zero clause bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e[ds]?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause) licen[cs]e[ds]?"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e[ds]?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|3 clause bsd|three clause bsd|bsd 3 clause) licen[cs]e[ds]?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|4 clause bsd|four clause bsd|bsd 4 clause) licen[cs]e[ds]?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e[ds]?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e (?:version |v)?2(?: 0)?|apache 2(?: 0)? licen[cs]e[ds]?"),
    ("gpl", "licen", r"(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl licen[cs]e[ds]?"),
    ("gpl-1.0", "gpl", r"gpl ?v?1(?: 0)? licen[cs]e[ds]?|gplv1"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)? licen[cs]e[ds]?|gplv2"),
    ("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)? licen[cs]e[ds]?|gplv3"),
    ("gpl-2.0", "licen", r"general public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "licen", r"general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl licen[cs]e[ds]?|lgplv[23](?: 1)?"),
    ("lgpl", "licen", r"(?:gnu )?lesser general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)? licen[cs]e[ds]?|agplv3"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "licen", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "licen", r"common development and distribution licen[cs]e"),
    ("eupl-1.2", "licen", r"european union public licen[cs]e"),
    ("cc0-1.0", "creative", r"creative commons zero(?: licen[cs]e)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1234] [05])? licen[cs]e"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])? licen[cs]e[ds]?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?(?: licen[cs]e[ds]?)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?(?: licen[cs]e[ds]?)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?(?: licen[cs]e[ds]?)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?(?: licen[cs]e[ds]?)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?(?: licen[cs]e[ds]?)?"),
    ("creative-commons", "creative", r"creative commons licen[cs]e[ds]?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e[ds]?"),
    ("bsl-1.0", "boost", r"boost(?: software)? licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ofl-1.1", "licen", r"(?:sil )?open font licen[cs]e"),
    ("odbl-1.0", "licen", r"open database licen[cs]e"),
    ("osl-3.0", "licen", r"open software licen[cs]e(?: 3 0)?"),
    ("afl-3.0", "licen", r"academic free licen[cs]e"),
    ("ecl-2.0", "licen", r"educational community licen[cs]e"),
    ("cpl-1.0", "licen", r"common public licen[cs]e"),
    ("ipl-1.0", "licen", r"ibm public licen[cs]e"),
    ("lppl", "licen", r"latex project public licen[cs]e"),
    ("qpl-1.0", "licen", r"q public licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("sspl-1.0", "licen", r"server side public licen[cs]e"),
    ("busl-1.1", "licen", r"business source licen[cs]e"),
]

#: Weak signs, in four languages.
SIGNS = [
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "rechte", r"alle rechte vorbehalten"),
    ("proprietary", "droits", r"tous droits r[eé]serv[eé]s"),
    ("proprietary", "derechos", r"(?:todos los derechos reservados|reservados todos los derechos)"),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("copyright-notice", "copyright", r"copyright (?:c )?by"),
    ("copyright-notice", "urheberrecht", r"urheberrechtlich gesch[uü]tzt"),
    ("public-domain", "domain", r"(?:in|to|into) the public domain"),
    ("public-domain", "domain", r"dans le domaine public"),
    ("public-domain", "gemeinfrei", r"gemeinfrei"),
    ("public-domain", "dominio", r"de dominio p[uú]blico"),
    ("warranty-disclaimer", "warrant", r"as is without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("warranty-disclaimer", "warrant", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", "warrant", r"(?:absolutely|comes with) no warranty"),
    ("warranty-disclaimer", "merchantability", r"(?:warranties|warranty) of merchantability"),
    ("liability-disclaimer", "liable", r"in no event shall the (?:authors|copyright holders?|copyright owner|regents) (?:or (?:[^ ]+ ){1,4})?be liable"),
    ("license-reference", "licen", r"see (?:the )?(?:file )?licen[cs]e(?: file)? for (?:more )?details"),
    ("license-reference", "copying", r"see (?:the )?(?:file )?copying(?: file)? for (?:more )?details"),
    ("license-reference", "licen", r"licen[cs]e information"),
    ("license-reference", "licen", r"third party licen[cs]es"),
    ("dual-license", "licen", r"dual licen[cs]ed"),
    ("dual-license", "licen", r"licen[cs]ed under the same terms as"),
    ("freeware", "freeware", r"freeware"),
    ("shareware", "shareware", r"shareware"),
    ("open-source", "licen", r"open source licen[cs]e"),
    ("trademark", "trademark", r"registered trademarks? of"),
    ("patent", "patent", r"patents? pending"),
]

#: Rules of one kind share priority (the smaller the better) and confidence.
KINDS = [(TAGS, 1, 1.0), (TEXTS, 2, 0.95), (NOTICES, 3, 0.9), (FIELDS, 4, 0.7), (NAMES, 5, 0.6), (SIGNS, 6, 0.4)]


def rules() -> list[dict]:
    """All rules, in their order: id, kw, re (around it the spaces of a padded row of words), label, priority, confidence."""
    made = [(*rule, priority, confidence) for kind, priority, confidence in KINDS for rule in kind]
    return [{"id": i, "kw": k, "re": f" ((?:{x}))(?= )", "label": n, "priority": p, "confidence": c} for i, (n, k, x, p, c) in enumerate(made)]
