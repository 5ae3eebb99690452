"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import LOWER, UPPER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, keywords of which any match of a name has one, the license's names, its SPDX identifier if it stands here); regexes over words with a blank between.
FAMILIES = [
    ("mit", "mit", "(?:the )?mit", "mit"),
    ("mit", "expat", "(?:the )?expat", None),
    ("mit", "x11", "(?:the )?x11", None),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("apache-1", "apache", "apache (?:software )?licen[cs]e (?:version )?1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache", "apache (?:software )?licen[cs]e (?:version )?2(?: 0)?|apache 2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", "clause", "(?:bsd 2 clause|2 clause bsd)", "bsd 2 clause"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd)", None),
    ("bsd-3-clause", "clause", "(?:bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|revised bsd|modified bsd)", None),
    ("bsd-4-clause", "clause", "(?:bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("bsd-4-clause", "bsd", "original bsd", None),
    ("0bsd", "clause", "(?:zero clause bsd|bsd zero clause)", "0bsd"),
    ("0bsd", "0bsd", "0bsd", None),
    ("isc", "isc", "isc", "isc"),
    ("gpl-1", "general  public|gpl", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v ?)?1(?: 0)?|gplv1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general  public|gpl", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v ?)?2(?: 0)?|gplv2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general  public|gpl", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?|gplv3", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general  public|gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)", "gpl"),
    ("lgpl-2", "lesser|library|lgpl", "(?:gnu )?(?:lesser|library) (?:general public licen[cs]e|gpl) (?:version |v ?)?2(?: [01])?|lgpl (?:version |v ?)?2(?: [01])?|lgplv2", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "lesser|lgpl", "(?:gnu )?lesser (?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?|lgpl (?:version |v ?)?3(?: 0)?|lgplv3", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser|library|lgpl", "(?:gnu )?(?:lesser|library) (?:general public licen[cs]e|gpl)|lgpl", "lgpl"),
    ("agpl-3", "affero|agpl", "(?:gnu )?affero (?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?|agpl (?:version |v ?)?3(?: 0)?|agplv3", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero|agpl", "(?:gnu )?affero (?:general public licen[cs]e|gpl)|agpl", "agpl"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e(?: version 1(?: [123])?)?", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "mozilla", "mozilla public licen[cs]e (?:version |v ?)?1(?: [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?", "epl 2 0"),
    ("cddl", "distribution", "common development and distribution licen[cs]e(?: (?:version |v ?)?1(?: [01])?)?", "cddl 1 [01]"),
    ("cpl", "common", "common public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?", "cpl 1 0"),
    ("eupl", "european", "european union public licen[cs]e(?: (?:version |v ?)?1(?: [012])?)?", "eupl 1 [012]"),
    ("artistic-1", "artistic", "artistic licen[cs]e (?:version )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic licen[cs]e (?:version )?2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng", "libpng(?: 2 0)?"),
    ("boost", "boost", "boost software licen[cs]e(?: (?:version )?1(?: 0)?)?", "bsl 1 0"),
    ("unlicense", "unlicen", "the unlicen[cs]e", "unlicense"),
    ("wtfpl", "wtfpl|want", "(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl"),
    ("python-2", "python", "python(?: software foundation)? licen[cs]e(?: (?:version )?2(?: 0)?)?", "(?:psf|python) 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("php", "php", "php licen[cs]e(?: (?:version )?3(?: 0?1?)?)?", "php 3 01?"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ncsa", "ncsa", "university of illinois ncsa open source", "ncsa"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("ofl", "open", "(?:sil )?open font licen[cs]e(?: (?:version )?1(?: [01])?)?", "ofl 1 [01]"),
    ("osl-3", "open", "open software licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?", "osl 3 0"),
    ("afl-3", "academic", "academic free licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?", "afl 3 0"),
    ("ecl-2", "educational", "educational community licen[cs]e(?: (?:version )?2(?: 0)?)?", "ecl 2 0"),
    ("odbl", "open", "open (?:data commons )?(?:open )?database licen[cs]e(?: 1(?: 0)?)?", "odbl 1 0"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e(?: 1(?: 0)?)?", "odc by 1 0"),
    ("pddl", "domain", "public domain dedication and licen[cs]e(?: 1(?: 0)?)?", "pddl 1 0"),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[cs]e)(?: (?:v ?)?[12])?", "mulanpsl [12] 0"),
    ("elastic-2", "elastic", "elastic licen[cs]e(?: (?:version )?2(?: 0)?)?", "elastic 2 0"),
    ("sspl", "server", "server side public licen[cs]e(?: (?:version |v ?)?1)?", "sspl 1 0"),
    ("busl", "business", "business source licen[cs]e(?: 1(?: 1)?)?", "busl 1 1"),
    ("cc0", "cc0", "cc0(?: 1(?: 0)?)?", "cc0 1 0"),
    ("cc0", "creative", "creative commons (?:zero|cc0)(?: 1(?: 0)?)?", None),
    ("cc-by", "cc  by|creative  commons", "(?:cc by|creative commons attribution)(?: [1234](?: [05])?)?", "cc by [1234] [05]"),
    ("cc-by-sa", "cc  by|creative  commons", "(?:cc by sa|creative commons attribution share ?alike)(?: [1234](?: [05])?)?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc  by|creative  commons", "(?:cc by nd|creative commons attribution no ?derivatives)(?: [1234](?: [05])?)?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "cc  by|creative  commons", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1234](?: [05])?)?", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc  by|creative  commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234](?: [05])?)?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc  by|creative  commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)(?: [1234](?: [05])?)?", "cc by nc nd [1234] [05]"),
    ("public-domain", "public  domain", "public domain", "public domain"),
    ("proprietary", "rights  reserved", "all rights reserved", "licenseref proprietary"),
]

#: Sentences of license texts, each with a keyword that is in it: (label, keywords, regexes), over words as above.
SIGNATURES = [
    ("mit", "permission", [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software",
    ]),
    ("mit", "warrant", ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"]),
    ("mit", "copyright", ["in no event shall the authors or copyright holders be liable for any claim damages or other liability"]),
    ("mit", "sublicen", ["to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell"]),
    ("mit", "advertising", ["shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authori[sz]ation"]),
    ("isc", "permission", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("isc", "warrant", ["the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"]),
    ("bsd", "redistribut", [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
    ]),
    ("bsd", "warrant", ["this software is provided by the (?:copyright holders?|authors?|regents) and contributors as is and any express or implied warranties"]),
    ("bsd-3-clause", "permission", [r"neither the names? of (?:\S+ ){1,9}may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd-4-clause", "advertising", ["all advertising materials mentioning features or use of this software must display the following acknowledge?ment"]),
    ("apache-1", "apache", ["this product includes software developed by the apache (?:group|software foundation)", "products derived from this software may not be called apache"]),
    ("apache-2", "apache", ["you may obtain a copy of the licen[cs]e at https? www apache org licen[cs]es licen[cs]e 2 0", "apache org licen[cs]es licen[cs]e 2 0"]),
    ("apache-2", "may  not  use  this|distributed  under  the|terms  and  conditions", [
        "you may not use this (?:file|software|work) except in compliance with the licen[cs]e",
        "software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind",
        "terms and conditions for use reproduction and distribution 1 definitions licen[cs]e shall mean",
        "grant of copyright licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants",
        "grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants",
    ]),
    ("gpl", "free  software", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"]),
    ("gpl", "warrant", ["this program is distributed in the hope that it will be useful but without any warranty"]),
    ("gpl", "general  public|verbatim  copies|most  software", [
        "you should have received a copy of the gnu general public licen[cs]e along with this program",
        "the licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom to share and change",
        "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed",
        "this general public licen[cs]e does not permit incorporating your program into proprietary programs",
    ]),
    ("gpl-2", "general  public", [
        "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2",
        "gnu general public licen[cs]e version 2 june 1991",
        "this licen[cs]e applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public licen[cs]e",
    ]),
    ("gpl-3", "general  public|explicitly  affirms", [
        "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3",
        "gnu general public licen[cs]e version 3 29 june 2007",
        "this licen[cs]e explicitly affirms your unlimited permission to run the unmodified program",
    ]),
    ("gpl-3", "copyright", ["protecting users legal rights from anti circumvention law no covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11 of the wipo copyright treaty"]),
    ("lgpl", "free  software", ["this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"]),
    ("lgpl", "warrant", ["this library is distributed in the hope that it will be useful but without any warranty"]),
    ("lgpl", "general  public", ["you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library"]),
    ("lgpl-2", "general  public", ["gnu lesser general public licen[cs]e version 2 1 february 1999", "gnu library general public licen[cs]e version 2 june 1991", "(?:lesser|library) general public licen[cs]e as published by the free software foundation (?:either )?version 2(?: 1)?"]),
    ("lgpl-3", "general  public", ["this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e", "lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3"]),
    ("agpl-3", "affero", ["gnu affero general public licen[cs]e version 3 19 november 2007", "affero general public licen[cs]e as published by the free software foundation (?:either )?version 3", "you should have received a copy of the gnu affero general public licen[cs]e along with this program"]),
    ("agpl-3", "modified  version", ["if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"]),
    ("gfdl", "permission", ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"]),
    ("gfdl", "invariant", ["with no invariant sections no front cover texts and no back cover texts a copy of the licen[cs]e is included"]),
    ("mpl-1", "mozilla", ["the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]", "the contents of this file are used with permission subject to the mozilla public licen[cs]e version 1 [01]"]),
    ("mpl-2", "mozilla", ["this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"]),
    ("mpl-2", "mpl", ["if a copy of the mpl was not distributed with this file you can obtain one at"]),
    ("epl-1", "eclipse", ["the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement", "terms of the eclipse public licen[cs]e v ?1 0 which accompanies this distribution"]),
    ("epl-2", "eclipse", ["terms of the eclipse public licen[cs]e v ?(?:ersion )?2 0 which (?:accompanies this distribution|is available at)", "this source code may also be made available under the following secondary licen[cs]es when the conditions for such availability set forth in the eclipse public licen[cs]e"]),
    ("cddl", "common  development|opensolaris", ["the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e"]),
    ("cpl", "common  public", ["the accompanying program is provided under the terms of this common public licen[cs]e agreement"]),
    ("eupl", "eupl", ["licen[cs]ed under the eupl(?: version)? 1 [012]", "this european union public licen[cs]e the eupl applies to the work"]),
    ("artistic-1", "copyright", ["the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"]),
    ("artistic-2", "package", ["this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"]),
    ("zlib", "warrant", ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"]),
    ("zlib", "permission", ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"]),
    ("zlib", "redistribut", ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution (?:or )?redistribution"]),
    ("boost", "permission", ["permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"]),
    ("boost", "boost", ["use modification and distribution (?:is|are) subject to the boost software licen[cs]e", "distributed under the boost software licen[cs]e version 1 0 see accompanying file"]),
    ("unlicense", "public  domain", ["this is free and unencumbered software released into the public domain"]),
    ("unlicense", "free  software", ["anyone is free to copy modify publish use compile sell or distribute this free software"]),
    ("wtfpl", "permi", ["everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed"]),
    ("python-2", "python", ["psf is making python available to licen[cs]ee on an as is basis", "psf hereby grants licen[cs]ee a nonexclusive royalty free world ?wide licen[cs]e to reproduce analy[sz]e test perform and or display publicly prepare derivative works distribute and otherwise use python"]),
    ("postgresql", "permission", ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"]),
    ("php", "permission", [r"the name php must not be used to endorse or promote products derived from this software without prior written permission", "products derived from this software may not be called php nor may php appear in their name without prior written permission"]),
    ("ruby", "copyright", ["you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"]),
    ("openssl", "openssl  project", ["this product includes software developed by the openssl project"]),
    ("openssl", "permission", ["the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software without prior written permission"]),
    ("ncsa", "without  restriction", ["to deal with the software without restriction"]),
    ("ms-pl", "governs  use", ["this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"]),
    ("ofl", " sil ", ["this font software is licen[cs]ed under the sil open font licen[cs]e"]),
    ("ofl", "font  software", ["neither the font software nor any of its individual components in original or modified versions may be sold by itself"]),
    ("osl-3", "open  software", ["this open software licen[cs]e the licen[cs]e applies to any original work of authorship"]),
    ("afl-3", "academic", ["this academic free licen[cs]e the licen[cs]e applies to any original work of authorship"]),
    ("odbl", "database", ["this (?:\\S+ ){1,8}is made available under the open database licen[cs]e", "any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e"]),
    ("pddl", "public  domain", ["is made available under the public domain dedication and licen[cs]e"]),
    ("elastic-2", "managed  service", ["you may not provide the software to third parties as a hosted or managed service"]),
    ("sspl", "third  parties", ["if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available via network download to everyone at no charge under the terms of this licen[cs]e"]),
    ("busl", "hereby  grants", ["the licen[cs]or hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[cs]ed work"]),
    ("cc0", "copyright", ["to the extent possible under law (?:\\S+ ){1,12}waived all copyright and related or neighbou?ring rights to"]),
    ("cc0", "public  domain", ["the person who associated a work with this deed has dedicated the work to the public domain"]),
    ("cc-by", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by [1234] [05]"]),
    ("cc-by-sa", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution share ?alike [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by sa [1234] [05]"]),
    ("cc-by-nd", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution no ?derivatives [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by nd [1234] [05]"]),
    ("cc-by-nc", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution non ?commercial [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by nc [1234] [05]"]),
    ("cc-by-nc-sa", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution non ?commercial share ?alike [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by nc sa [1234] [05]"]),
    ("cc-by-nc-nd", "creative  commons|creativecommons", ["this work is licen[cs]ed under a creative commons attribution non ?commercial no ?derivatives [1234] 0 international licen[cs]e", "creativecommons org licen[cs]es by nc nd [1234] [05]"]),
    ("public-domain", "public  domain", ["(?:dedicated|released) (?:in)?to the public domain", "(?:is|are) in the public domain"]),
    ("proprietary", "may  be  reproduced", ["no part of this (?:publication|book|work|document|software) may be reproduced"]),
    ("proprietary", "permission", ["reproduction in whole or in part without (?:\\S+ ){0,3}permission is prohibited"]),
    ("proprietary", "confidential  and  proprietary", ["th(?:is|e) software is the confidential and proprietary (?:information|property) of"]),
    ("proprietary", "not  sold|end  user", ["this software is licen[cs]ed not sold", "use of this software is governed by (?:the )?end user licen[cs]e agreement"]),
]

#: Where a license is named: the first of these that fits decides; the last two only for names that stand for their license by themselves.
TEMPLATES = [
    "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?",
    "(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name}) licen[cs]e",
    "(?:{name}) licen[cs]e(?: agreement)?",
    "licen[cs]e (?:{name})",
    "(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})",
    "(?:{name})",
]
#: How many of them any name may stand in.
OF_ANY_NAME = 4
#: What a match of a name or an identifier starts or ends with: its priority and confidence, the first that fits; a text's has its own.
SPDX = "spdx licen[cs]e identifier (?:{spdx})"
RANKS = [
    ("starts", (" spdx  ",), 4, 1.0),
    ("starts", (" licensed  ", " licenced  "), 3, 0.95),
    ("starts", (" released  ", " distributed  ", " available  ", " published  ", " provided  "), 3, 0.9),
    ("ends", ("  license ", "  licence ", "  agreement "), 2, 0.8),
    ("starts", (" license  ", " licence  "), 2, 0.7),
]
OF_TEXT, OF_NAME_ALONE = (3, 0.85), (1, 0.6)
#: Any match has one of these in it; a name that has one may stand alone.
GATES = ("licen", "spdx", " cc  ", " cc0 ", "creative  commons", "public  domain", "rights  reserved", "gpl", "apache", "wtfpl", "mulan", " 0bsd ", "clause")
GATES_OF_TEXTS = ("permission", "permitted", "redistribut", "warrant", "copyright", "free  software", "advertising", "modified  version", " mpl ", "without  restriction", "font  software", "managed  service", "may  be  reproduced", "confidential  and  proprietary", "openssl  project")
BASE_CONFIDENCE = 0.9


def rules() -> list[tuple[int, str, str, str, bool]]:
    """(number, label, keywords, regex, whether of a text), in order of rank: texts, names, identifiers. Blanks become the two between words.

    A rule's regex is an ordered alternation; where it matches, the first alternative that fits is taken, and the search
    goes on behind the match.
    """
    out = [(label, keyword, some, True) for label, keyword, some in SIGNATURES]
    for label, keyword, name, spdx in FAMILIES:
        alone = any(g.replace("  ", " ").strip() in name for g in GATES)
        some = [t.replace("{name}", name) for t in (TEMPLATES if alone else TEMPLATES[:OF_ANY_NAME])]
        out.append((label, keyword, some, False))
    out += [(label, "spdx", [SPDX.replace("{spdx}", spdx)], False) for label, _, _, spdx in FAMILIES if spdx]
    return [(n, label, keyword, " (?:" + "|".join(map(spaced, some)) + ") ", of_text) for n, (label, keyword, some, of_text) in enumerate(out)]


def signatures() -> list[tuple[str, str]]:
    """(label, regex) of every single signature: each text, each name in each template."""
    out = [(label, r) for label, _, some in SIGNATURES for r in some]
    out += [(label, t.replace("{name}", name)) for label, _, name, _ in FAMILIES for t in TEMPLATES]
    return out + [(label, SPDX.replace("{spdx}", spdx)) for label, _, _, spdx in FAMILIES if spdx]


def spaced(regex: str) -> str:
    """Two blanks for one; an optional blank within a name stays an optional pair."""
    return regex.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")


def scanned(text: Column) -> Column:
    """The words of a text, each between two blanks; two blanks without words.

    Every ASCII character that is in no word becomes a blank, runs of blanks become one (a mark is put behind each, and
    goes where another blank follows), all by plain replacement: that is several times as fast as a regex.
    """
    blank = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    flat = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), blank + UPPER, " " * len(blank) + LOWER)
    for old, new in ((" ", " \x01"), ("\x01 ", ""), (" \x01", "  ")):
        flat = F.replace(flat, F.lit(old), F.lit(new))
    return flat


def words_in(c: Column) -> Column:
    """Words of a part of scanned text that ends with one blank, and begins with one or, at the text's start, two."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")


SPAN = "array<struct<start:bigint,minus_end:bigint,minus_priority:int,number:int,label:string,confidence:double>>"


def _rank(match: Column, of_text: Column) -> tuple[Column, Column]:
    """Priority and confidence of a match."""
    priority, confidence = F.when(of_text, F.lit(OF_TEXT[0])), F.when(of_text, F.lit(OF_TEXT[1]))
    for where, signs, p, c in RANKS:
        fits = F.lit(False)
        for x in signs:
            fits = fits | (F.startswith(match, F.lit(x)) if where == "starts" else F.endswith(match, F.lit(x)))
        priority, confidence = priority.when(fits, F.lit(p)), confidence.when(fits, F.lit(c))
    return priority.otherwise(F.lit(OF_NAME_ALONE[0])), confidence.otherwise(F.lit(OF_NAME_ALONE[1]))


def _spans(hit: Column) -> Column:
    """Every match of a rule (number, label, of_text, found): (start, -end, -priority, number, label, confidence), in words.

    The matches are found again by their text, each behind the one before: had it stood further ahead, the regex would
    have matched there.
    """

    def step(acc: Column, match: Column) -> Column:
        at = F.call_function("locate", match, F.col("words"), acc["at"])
        start = words_in(F.left(F.col("words"), at - 1))
        end = start + words_in(match)
        priority, confidence = _rank(match, hit["of_text"])
        span = F.struct(start.alias("start"), (-end).alias("minus_end"), (-priority).alias("minus_priority"), hit["number"].alias("number"), hit["label"].alias("label"), confidence.alias("confidence"))
        return F.struct((at + F.length(match)).alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    none = F.struct(F.lit(1).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(hit["found"], none, step, lambda acc: acc["spans"])


def _hits() -> Column:
    """What each rule of which a keyword stands here finds. Regexes are constants: each is compiled once a task."""
    of_rule = (
        f"CASE WHEN {' OR '.join(f"contains(words, '{k}')" for k in keywords.split('|'))} THEN named_struct('number', {number}, 'label', '{label}', 'of_text', {str(of_text).lower()}, "
        f"'found', regexp_extract_all(words, r'{regex}', 0)) END"
        for number, label, keywords, regex, of_text in rules()
    )
    return F.filter(F.expr(f"array({', '.join(of_rule)})"), lambda h: h.isNotNull() & (F.size(h["found"]) > 0))


def _uncontained(spans: Column) -> Column:
    """Spans, sorted, without those inside another of the same or a higher priority.

    In this order whatever contains a span stands before it, so the furthest end so far for each priority decides.
    """

    def step(acc: Column, s: Column) -> Column:
        end, priority = -s["minus_end"], -s["minus_priority"]
        inside = F.element_at(acc["far"], priority) >= end
        reach = F.transform(acc["far"], lambda m, i: F.when((i < priority) & (end > m), end).otherwise(m))
        return F.struct(F.when(inside, acc["far"]).otherwise(reach).alias("far"), F.when(inside, acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"))

    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), 4).alias("far"), F.slice(spans, 1, 0).alias("kept"))
    return F.aggregate(spans, start, step, lambda acc: acc["kept"])


def license_spans(docs: DataFrame) -> DataFrame:
    """docs with `words` (as scanned), `may` (whether one of the gates is there) and `spans`: array of (start, minus_end, minus_priority, number, label, confidence).

    A text without any of GATES has no span and costs that look only; in the others a family's regexes run where its
    keyword stands. Spans are counted in words from 0, end exclusive; overlapping ones are resolved by _uncontained.
    A row is read once and nothing is shuffled, so no hot text or label gathers anywhere.
    """
    gate = F.lit(False)
    for g in (*GATES, *GATES_OF_TEXTS):
        gate = gate | F.contains("words", F.lit(g))
    spans = F.flatten(F.transform(_hits(), _spans))
    found = docs.withColumn("words", scanned(F.col("text"))).withColumn("may", gate)
    found = found.withColumn("spans", F.when(F.col("may"), F.array_sort(spans)).otherwise(F.array().cast(SPAN)))
    return found.withColumn("spans", F.when(F.size("spans") > 1, _uncontained(F.col("spans"))).otherwise(F.col("spans")))


def license_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each document.

    Base phrases count wherever their words stand side by side. labels has theirs and those of the rules' spans;
    score is the highest confidence among them, 0 without any. A null text is empty: counts 0, null places, empty
    labels. Repeated rows stay; null doc_ids stay null; an empty table gives no rows; extra columns are ignored.
    """
    found = license_spans(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    words, whole = F.col("words"), F.length("words")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        p = " " + phrase.replace(" ", "  ") + " "
        here = F.col("may") & F.contains(words, F.lit(p))
        n = ((whole - F.length(F.replace(words, F.lit(p), F.lit("")))) / len(p)).cast("long")
        last = whole - F.length(F.substring_index(words, p, -1)) - len(p)
        counts.append(F.when(here, n).otherwise(0))
        firsts.append(F.when(here, words_in(F.substring_index(words, p, 1))))
        lasts.append(F.when(here, words_in(F.left(words, last))))
        labels.append(F.when(here, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    own = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.transform("spans", lambda s: s["confidence"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id",
        (words_in(words) - 1).alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        score.alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
