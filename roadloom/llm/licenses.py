"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: digits, letters, anything beyond ASCII. Case does not matter to where words are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Priorities, the strongest first. A detection inside one of the same or a stronger kind is dropped.
IDENTIFIER, TEXT, GRANT, VERSIONED, NAMED = 0, 1, 2, 3, 4
#: How far a kind of detection is to be trusted.
TRUST = {IDENTIFIER: 1.0, TEXT: 0.95, GRANT: 0.95, VERSIONED: 0.9, NAMED: 0.7}

#: Phrases whose labels always stay.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    """A regex over lower-case words with single spaces, tried where any of ``keywords`` is a word of the text."""

    keywords: tuple[str, ...]
    pattern: str
    label: str
    priority: int
    base: bool = False


#: label stem, pattern of the name, keyword, versions
FAMILIES = [
    ("gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)", "gpl|general", ("1.0", "2.0", "2", "3.0", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl", "lgpl|lesser|library", ("2.0", "2.1", "2", "3.0", "3")),
    ("agpl", "(?:gnu )?affero general public licen[cs]e|(?:gnu )?agpl", "agpl|affero", ("1.0", "3.0", "3")),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e|gfdl", "gfdl|documentation", ("1.1", "1.2", "1.3")),
    ("apache", "apache(?: software)? licen[cs]e|apache", "apache", ("1.0", "1.1", "2.0", "2")),
    ("mpl", "mozilla public licen[cs]e|mpl", "mozilla|mpl", ("1.0", "1.1", "2.0", "2")),
    ("epl", "eclipse public licen[cs]e|epl", "eclipse|epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution licen[cs]e|cddl", "cddl|development", ("1.0", "1.1")),
    ("cpl", "common public licen[cs]e", "common", ("0.5", "1.0")),
    ("eupl", "european union public licen[cs]e|eupl", "eupl|european", ("1.0", "1.1", "1.2")),
    ("osl", "open software licen[cs]e|osl", "osl|open", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free licen[cs]e|afl", "afl|academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "(?:perl )?artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("bsl", "boost software licen[cs]e|bsl", "boost|bsl", ("1.0",)),
    ("busl", "business source licen[cs]e|busl", "business|busl", ("1.1",)),
    ("zpl", "zope public licen[cs]e|zpl", "zope|zpl", ("1.1", "2.0", "2.1")),
    ("lppl", "latex project public licen[cs]e|lppl", "latex|lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("ofl", "(?:sil )?open font licen[cs]e|ofl", "ofl|font", ("1.0", "1.1")),
    ("odbl", "open (?:data commons open )?database licen[cs]e|odbl", "odbl|database", ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e|odc by", "odc|commons", ("1.0",)),
    ("php", "php licen[cs]e", "php", ("3.0", "3.01")),
    ("python", "python(?: software foundation)? licen[cs]e|psf licen[cs]e", "python|psf", ("2.0", "2")),
    ("ms-pl", "microsoft public licen[cs]e|ms pl", "microsoft|ms", ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e|ms rl", "microsoft|ms", ()),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", ()),
    ("isc", "isc licen[cs]e", "isc", ()),
    ("mit", "mit(?: x11)? licen[cs]e|expat licen[cs]e", "mit|expat", ()),
    ("mit-0", "mit no attribution(?: licen[cs]e)?|mit 0", "mit", ()),
    ("x11", "x11 licen[cs]e", "x11", ()),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("libpng", "(?:png reference library|libpng) licen[cs]e", "libpng|png", ("1.6.35", "2.0")),
    ("unlicense", "the unlicense|unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("bsd-0-clause", "(?:0|zero) clause bsd(?: licen[cs]e)?|0bsd", "bsd|0bsd", ()),
    ("bsd-2-clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd|freebsd", ()),
    ("bsd-3-clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: licen[cs]e)?", "bsd", ()),
    ("bsd-4-clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?", "bsd", ()),
    ("bsd", "bsd(?: style)? licen[cs]e", "bsd", ()),
    ("cc0", "cc0|creative commons zero|cc zero", "cc0|zero", ("1.0",)),
    ("cc-by", "cc by|creative commons attribution(?: international| unported| generic)?", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc|commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "domain", ()),
    ("proprietary", "all rights reserved", "reserved", ()),
    ("upl", "universal permissive licen[cs]e|upl", "permissive|upl", ("1.0",)),
    ("ecl", "educational community licen[cs]e|ecl", "educational|ecl", ("1.0", "2.0")),
    ("cecill", "cecill(?: licen[cs]e)?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("cpal", "common public attribution licen[cs]e|cpal", "cpal|attribution", ("1.0",)),
    ("elastic", "elastic licen[cs]e", "elastic", ("1.0", "2.0")),
    ("sspl", "server side public licen[cs]e|sspl", "sspl|server", ("1.0", "1")),
    ("openssl", "openssl licen[cs]e", "openssl", ()),
    ("postgresql", "postgresql licen[cs]e", "postgresql", ()),
    ("ruby", "ruby licen[cs]e", "ruby", ()),
    ("vim", "vim licen[cs]e", "vim", ()),
    ("w3c", "w3c(?: software(?: notice and)?)? licen[cs]e", "w3c", ()),
    ("json", "json licen[cs]e", "json", ()),
    ("beerware", "beerware(?: licen[cs]e)?|beer ware licen[cs]e", "beerware|beer", ()),
    ("openrail", "(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", "openrail|rail", ()),
    ("llama", "llama (?:2|3) community licen[cs]e", "llama", ()),
    ("ogl", "open government licen[cs]e|ogl", "government|ogl", ("1.0", "2.0", "3.0")),
]


#: Signatures of license texts, notices and clauses: label, keywords, pattern. A keyword is a word that every match has, the rarest at hand.
TEXTS = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | noninfringement | fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
mit | furnished | to permit persons to whom the software is furnished to do so
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11-distribute-modifications | sublicense | use copy modify merge publish distribute distribute with modifications sublicense and or sell copies
isc | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | disclaims | the software is provided as is and (?:the author|isc|internet systems consortium(?: inc)?) disclaims all warranties with regard to this software
0bsd | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)
mit-0 | sublicense | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
bsd-2-clause-views | views | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-2-clause-patent | irrevocable | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable
bsd-3-clause | endorse | (?:neither )?the names? of (?:[^ ]+ ){1,12}(?:nor the names of (?:its|their|his|the) contributors )?may (?:not )?be used to endorse or promote products derived from this software
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-source-code | redistributions | redistributions of source code must retain the above copyright notice(?! this list)
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | implied | this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages
zlib | altered | this notice may not be removed or altered from any source distribution
libpng | png | the png reference library is supplied as is
libpng | altered | this copyright notice may not be removed or altered from any source or altered source distribution
bsl-1.0 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | derivative | must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies
bsl-1.0 | boost | distributed under the boost software license version 1 0
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | applicable | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | reproduction | terms and conditions for use reproduction and distribution
apache-2.0 | contributor | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | apache | you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | appendix | appendix how to apply the apache license to your work
apache-1.1 | apache | products derived from this software may not be called apache nor may apache appear in their name
apache-1.1 | apache | this product includes software developed by the apache software foundation
apache-1.0 | apache | this product includes software developed by the apache group
gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | gnu | you should have received a copy of the gnu general public license
gpl | freedom | the licenses? for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl | freedom | when we speak of free software we are referring to freedom not price
gpl | gnu | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-1.0 | gnu | gnu general public license version 1 february 1989
gpl-2.0 | gnu | gnu general public license version 2 june 1991
gpl-2.0 | gnu | under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-2.0-or-later | later | as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | gnu | gnu general public license version 3 29 june 2007
gpl-3.0-or-later | later | as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-with-classpath-exception | statically | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-with-autoconf-exception | autoconf | as a special exception (?:[^ ]+ ){0,12}configure script generated by autoconf
gpl-with-bison-exception | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-3.0-with-gcc-exception | gcc | gcc runtime library exception(?: version 3 1)?
gpl-with-font-exception | font | as a special exception if you create a document which uses this font and embed this font
linux-syscall-note | kernel | this copyright does not cover user programs that use kernel services by normal system calls
lgpl | library | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | library | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl | lesser | we call this license the lesser general public license because it does less to protect the user s freedom
lgpl-2.0 | library | gnu library general public license version 2 june 1991
lgpl-2.1 | lesser | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lesser | gnu lesser general public license version 3 29 june 2007
lgpl-3.0 | lesser | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3.0 | affero | gnu affero general public license version 3 19 november 2007
agpl | affero | under the terms of the gnu affero general public license as published by the free software foundation
agpl | network | if your software can interact with users remotely through a (?:computer )?network you should also make sure that it provides a way for users to get its source
agpl-3.0 | remote | remote network interaction use with the gnu general public license
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible | this source code form is incompatible with secondary licenses as defined by the mozilla public license
npl-1.1 | netscape | the contents of this file are subject to the netscape public license
epl-1.0 | eclipse | all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl | recipient | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl-1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | common | the accompanying program is provided under the terms of this common public license
ipl-1.0 | ibm | the accompanying program is provided under the terms of this ibm public license
eupl | eupl | licensed under the eupl(?: version 1 [0-2])?(?: or as soon they will be approved by the european commission)?
eupl | european | this european union public licence the eupl applies to the work
osl-3.0 | open | licensed under the open software license version 3 0
afl-3.0 | academic | licensed under the academic free license version 3 0
artistic | artistic | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | preamble | everyone is permitted to copy and distribute verbatim copies of this license document preamble this license establishes the terms under which a given free software package
perl | perl | this (?:library|module|program|software) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself
python-2.0 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform
python-2.0 | cwi | cwi license agreement for python 0 9 0 through 1 2
cnri-python | cnri | cnri hereby grants licensee a nonexclusive royalty free world wide license
php-3.01 | php | this product includes php software freely available from
php-3.01 | php | the name php must not be used to endorse or promote products derived from this software
zpl-2.1 | zope | use in source code of the zope name is not permitted
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic | this product includes cryptographic software written by eric young
unicode | unicode | unicode data files and software
unicode | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ncsa | ncsa | university of illinois ncsa open source license
ncsa | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
w3c | obtaining | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
postgresql | agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | hereby | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:without|with or without) fee is hereby granted provided that the above copyright notice appears? in all copies
curl | hereby | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ntp | suitability | makes no representations about the suitability (?:of )?this software for any purpose it is provided as is without express or implied warranty
tcl | grant | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
json | evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
wtfpl | fuck | you just do what the fuck you want to
wtfpl | fuck | do what the fuck you want to public license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | for more information please refer to https? (?:www )?unlicense org
cc0-1.0 | waived | to the extent possible under law (?:[^ ]+ ){1,10}waived all copyright and related or neighboring rights
cc0-1.0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-by-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution 4 0 international license
cc-by-sa-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution share ?alike 4 0 international license
cc-by-nc-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution non ?commercial 4 0 international license
cc-by-sa-3.0 | creative | text is available under the creative commons attribution share ?alike license
cc | creative | by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved | no modified version of the font software may use the reserved font name
odbl-1.0 | database | this database is made available under the open database license
odc-by-1.0 | attribution | this database is made available under the open data commons attribution license
pddl-1.0 | dedication | open data commons public domain dedication (?:and|amp) licen[cs]e
ogl-3.0 | government | contains public sector information licensed under the open government licen[cs]e v3 0
public-domain | domain | (?:is|are|has been|have been) (?:hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | this (?:file|work|software|program|code) is (?:in )?(?:the )?public domain
public-domain-us-gov | government | (?:this is )?a work of the (?:united states|u s) government and (?:is )?(?:therefore )?(?:not subject to copyright|in the public domain)
ms-pl | accompanying | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | recipients | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | managed | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | clause | commons clause license condition v1 0
commons-clause | sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
openrail | restrictions | use based restrictions as referenced in paragraph 5
llama | meta | llama [23](?: [0-9])? is licensed under the (?:llama [23](?: [0-9])? community|meta llama [23](?: [0-9])? community) license
proprietary | confidential | (?:this (?:software|document|file) (?:is|contains) )?(?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:[^ ]+ ){0,10}is (?:strictly )?prohibited
proprietary | reproduced | no part of this (?:publication|document|work|book|software) may be reproduced
proprietary | reverse | you may not reverse engineer decompile or disassemble the software
non-commercial | commercial | (?:for|free for) (?:personal and )?non ?commercial (?:use|purposes) only
academic-use | academic | for (?:academic|research)(?: and (?:academic|research|educational))? (?:use|purposes) only
evaluation | evaluation | for evaluation (?:use|purposes) only
"""


def _spaced(words: str) -> str:
    return re.sub("[^a-z0-9]+", " ", words).strip()


def rules() -> list[Rule]:
    """The rules in their order, each pattern once: the base phrases, the texts, then for each family its identifiers, grant, versioned and named forms."""
    out = [Rule((phrase.split()[0],), phrase, label, NAMED, True) for phrase, label in BASE.items()]
    for line in filter(None, TEXTS.split("\n")):
        label, keyword, pattern = line.split(" | ", 2)
        out.append(Rule((keyword,), pattern, label, TEXT))
    for stem, name, keywords, versions in FAMILIES:
        words = tuple(keywords.split("|"))
        for v in versions:
            number = _spaced(v).replace(" ", "[ ]")
            out.append(Rule(words, f"(?:{name})(?: international| unported| generic)?(?: version| ver| v)? v?{number}(?! [0-9])(?: or(?: any)? later)?", f"{stem}-{v if '.' in v or stem == 'wtfpl' else v + '.0'}", VERSIONED))
        out.append(Rule(words, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:{name})", stem, GRANT))
        out.append(Rule(words, f"(?:{name})", stem, NAMED))
        for label in (stem, *(f"{stem}-{v}" for v in versions if "." in v)):
            out.append(Rule(("spdx",), f"spdx license identifier {_spaced(label)}(?: only| or later)?(?! [0-9])", label, IDENTIFIER))
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Detections of one rule: where its matches start and stop, in words, from the gaps between them."""
    regex = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    gaps, matches = F.split(words, regex), F.regexp_extract_all(words, regex, F.lit(0))
    found = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    step = lambda acc, x: F.struct(
        (acc["at"] + _spaces(x["gap"]) + F.coalesce(_spaces(x["match"]), F.lit(0))).alias("at"),
        F.when(
            x["match"].isNotNull(),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + _spaces(x["gap"]) - 1).cast("long").alias("start"), (acc["at"] + _spaces(x["gap"]) + _spaces(x["match"]) - 1).cast("long").alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{_DETECTION}>").alias("out"))
    return F.aggregate(found, zero, step, lambda acc: acc["out"])


_DETECTION = "struct<start:bigint,stop:bigint,priority:int,label:string,base:boolean>"


def _surviving(found: Column) -> Column:
    """Detections that no earlier, wider one of the same or a stronger kind contains; base ones always."""
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).when(a["stop"] != b["stop"], F.signum(b["stop"] - a["stop"])).otherwise(F.signum(a["priority"] - b["priority"])).cast("int")
    kinds = range(NAMED + 1)

    def step(acc: Column, x: Column) -> Column:
        widest = [F.greatest(*[acc[f"m{i}"] for i in range(k + 1)], F.lit(-1).cast("long")) for k in kinds]
        hidden = F.coalesce(*[F.when(x["priority"] == k, widest[k] >= x["stop"]) for k in kinds])
        return F.struct(
            *[F.when(~x["base"] & (x["priority"] == k), F.greatest(acc[f"m{k}"], x["stop"])).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in kinds],
            F.when(x["base"] | ~hidden, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(*[F.lit(-1).cast("long").alias(f"m{k}") for k in kinds], F.lit([]).cast(f"array<{_DETECTION}>").alias("out"))
    return F.aggregate(F.array_sort(found, order), zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, detections) of every row; a detection has start and stop (words from 0), priority, label, base.

    Each text becomes its lower-case words with single spaces. A rule is tried if one
    of its keywords is one of these words; its matches are found by a regex over them. Detections
    that lie inside one of the same or a stronger kind are dropped, base ones stay. Null
    texts count as empty: no words, no detections. Null ids and repeated rows stay as they
    are; an empty table gives an empty result; other columns are not read. Everything
    happens in the row; there is no shuffle.
    """
    rule_list = rules() if rule_list is None else rule_list
    keywords = sorted({k for r in rule_list for k in r.keywords})
    table = F.array(*[F.struct(F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.base).alias("base")) for r in rule_list])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Words of the text lowered by the book are as many, and have every keyword that the text has with A-Z lowered.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    exact = F.concat(F.lit(" "), F.translate(F.array_join(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), " "), _UPPER, _LOWER), F.lit(" "))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", F.array(*map(F.lit, keywords))), exact).alias("line"))
    present = F.when(F.col("line").isNotNull(), F.array_intersect(F.split("line", " "), F.array(*map(F.lit, keywords))))
    rows = rows.withColumn("present", present)
    tried = F.filter(table, lambda r: F.arrays_overlap(F.col("present"), r["keywords"]))
    found = F.flatten(F.transform(tried, lambda r: _places(F.col("line"), r)))
    rows = rows.withColumn("found", F.when(F.size("present") > 0, found))
    none = F.lit([]).cast(f"array<{_DETECTION}>")
    return rows.select("doc_id", "n_words", F.when(F.size("found") > 0, _surviving(F.col("found"))).otherwise(none).alias("detections"))


def _labels(detections: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def summarised(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of the rows of ``scan``."""
    rows = scanned.withColumn("base", F.filter("detections", lambda d: d["base"]))
    starts = F.transform("base", lambda d: d["start"])
    trust = F.array_max(F.transform("detections", lambda d: F.when(d["base"], F.lit(1.0)).otherwise(F.coalesce(*[F.when(d["priority"] == k, F.lit(v)) for k, v in TRUST.items()]))))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"), _labels(F.col("detections")).alias("labels"), F.coalesce(trust, F.lit(0.0)).alias("score"),
    )
