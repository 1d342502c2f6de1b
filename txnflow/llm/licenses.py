"""License scan by ordered signature rules.

Rules are regular expressions in order of priority. First come phrases of the licenses' own texts and notices, the longer
ones before; then forms of naming a license (tag, address, statement, title, short name) for each license of a table, an earlier form
being more certain. A rule runs only on texts that contain what its form asks for and one of its gates. Both are parts of the
pattern itself, so every match contains them. Of overlapping detections those that lie within another one are dropped, the same
interval staying with the rule of highest priority; of neighbours that overlap in part the one of lower priority is dropped;
what is left names the labels.

Besides, the base phrases are counted over all texts: places where the words of a phrase stand consecutively. Words are
runs of ASCII letters and digits and non-ASCII characters, compared with A-Z as a-z.

Defined cases: null and empty texts have no words, labels or score; rows that repeat id and text get equal results; an empty
table gives no rows; other columns are ignored, whatever their names; texts of any length are searched whole. Only DataFrame
functions are used.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnflow.llm.shared import packed

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label :: tag :: names (patterns without the word license, by semicolons) :: address
LICENSES = """
mit :: mit :: mit;mit/x11;expat :: opensource.org/licenses/mit
apache :: apache-[12]\\.[01] :: apache(?: software)? :: apache.org/licenses
gpl :: gpl-[123]\\.0(?:-only|-or-later|\\+)? :: (?:gnu )?general public;gnu gpl :: gnu.org/licenses/gpl
lgpl :: lgpl-[23]\\.[01](?:-only|-or-later|\\+)? :: (?:gnu )?lesser general public;gnu lgpl :: gnu.org/licenses/lgpl
agpl :: agpl-3\\.0(?:-only|-or-later|\\+)? :: (?:gnu )?affero general public;gnu agpl :: gnu.org/licenses/agpl
gfdl :: gfdl-1\\.[123](?:-only|-or-later)? :: (?:gnu )?free documentation :: gnu.org/licenses/fdl
bsd :: bsd-[234]-clause :: (?:(?:new|modified|simplified|[234]-clause) )?bsd(?: [234]-clause)? :: opensource.org/licenses/bsd
0bsd :: 0bsd :: zero-clause bsd;0bsd :: opensource.org/licenses/0bsd
isc :: isc :: isc :: opensource.org/licenses/isc
mpl :: mpl-[12]\\.[01] :: mozilla public :: mozilla.org/mpl
epl :: epl-[12]\\.0 :: eclipse public :: eclipse.org/legal/epl
edl :: edl-1\\.0 :: eclipse distribution :: eclipse.org/org/documents/edl
cddl :: cddl-1\\.[01] :: common development and distribution :: opensource.org/licenses/cddl
cpl :: cpl-1\\.0 :: common public :: opensource.org/licenses/cpl
cpal :: cpal-1\\.0 :: common public attribution :: opensource.org/licenses/cpal
cc-by :: cc-by-[1234]\\.[05] :: cc by;creative commons attribution :: creativecommons.org/licenses/by/
cc-by-sa :: cc-by-sa-[1234]\\.[05] :: cc by-sa;creative commons attribution-sharealike :: creativecommons.org/licenses/by-sa
cc-by-nc :: cc-by-nc-[1234]\\.[05] :: cc by-nc;creative commons attribution-noncommercial :: creativecommons.org/licenses/by-nc/
cc-by-nd :: cc-by-nd-[1234]\\.[05] :: cc by-nd;creative commons attribution-noderiv(?:ative)?s :: creativecommons.org/licenses/by-nd
cc-by-nc-sa :: cc-by-nc-sa-[1234]\\.[05] :: cc by-nc-sa;creative commons attribution-noncommercial-sharealike :: creativecommons.org/licenses/by-nc-sa
cc-by-nc-nd :: cc-by-nc-nd-[1234]\\.[05] :: cc by-nc-nd;creative commons attribution-noncommercial-noderiv(?:ative)?s :: creativecommons.org/licenses/by-nc-nd
cc0 :: cc0-1\\.0 :: cc0;creative commons zero :: creativecommons.org/publicdomain/zero
public-domain :: publicdomain :: public domain :: creativecommons.org/publicdomain/mark
unlicense :: unlicense :: the unlicense :: unlicense.org
wtfpl :: wtfpl :: do what the fuck you want to public;wtfpl :: wtfpl.net
zlib :: zlib :: zlib(?:/libpng)? :: zlib.net/zlib_license
libpng :: libpng(?:-2\\.0)? :: libpng :: libpng.org/pub/png/src/libpng-license
bsl :: bsl-1\\.0 :: boost software :: boost.org/license_1_0
bus :: busl-1\\.1 :: business source :: mariadb.com/bsl11
sspl :: sspl-1\\.0 :: server side public :: mongodb.com/licensing/server-side-public-license
elastic :: elastic-2\\.0 :: elastic :: elastic.co/licensing
artistic :: artistic-[12]\\.0(?:-perl)? :: artistic :: opensource.org/licenses/artistic
psf :: psf-2\\.0 :: python software foundation :: docs.python.org/3/license
python :: python-2\\.0(?:\\.1)? :: python :: opensource.org/licenses/python
php :: php-3\\.0[01]? :: php :: php.net/license
ruby :: ruby :: ruby :: ruby-lang.org/en/about/license
tcl :: tcl :: tcl/tk :: tcl.tk/software/tcltk/license
postgresql :: postgresql :: postgresql :: opensource.org/licenses/postgresql
openssl :: openssl :: openssl :: openssl.org/source/license
curl :: curl :: curl :: curl.se/docs/copyright
x11 :: x11 :: x11;x consortium :: x.org/licenses
ncsa :: ncsa :: university of illinois/ncsa open source :: opensource.org/licenses/ncsa
upl :: upl-1\\.0 :: universal permissive :: opensource.org/licenses/upl
afl :: afl-[123]\\.[01] :: academic free :: opensource.org/licenses/afl
osl :: osl-[123]\\.[01] :: open software :: opensource.org/licenses/osl
eupl :: eupl-1\\.[012] :: european union public :: joinup.ec.europa.eu/software/page/eupl
ecl :: ecl-[12]\\.0 :: educational community :: opensource.org/licenses/ecl
mspl :: ms-pl :: microsoft public :: opensource.org/licenses/ms-pl
msrl :: ms-rl :: microsoft reciprocal :: opensource.org/licenses/ms-rl
ofl :: ofl-1\\.[01] :: (?:sil )?open font :: scripts.sil.org/ofl
odbl :: odbl-1\\.0 :: open database :: opendatacommons.org/licenses/odbl
odc-by :: odc-by-1\\.0 :: open data commons attribution :: opendatacommons.org/licenses/by
pddl :: pddl-1\\.0 :: public domain dedication and :: opendatacommons.org/licenses/pddl
cecill :: cecill-(?:[12]\\.[01]|b|c) :: cecill(?:-[bc])? :: cecill.info
latex :: lppl-1\\.[0123][ac]? :: latex project public :: latex-project.org/lppl
mulan :: mulanpsl-[12]\\.0 :: mulan (?:permissive software|psl) :: license.coscl.org.cn/mulanpsl
openrail :: (?:big(?:code|science)-)?openrail(?:-m)? :: (?:creativeml |bigscience )?open ?rail(?:-m)? :: huggingface.co/spaces/bigcode
llama :: llama[23](?:\\.[12])? :: llama [23](?:\\.[12])? community :: ai.meta.com/llama/license
gemma :: gemma :: gemma terms of use :: ai.google.dev/gemma/terms
jquery :: jquery :: jquery :: jquery.org/license
sleepycat :: sleepycat :: sleepycat :: opensource.org/licenses/sleepycat
qpl :: qpl-1\\.0 :: q public :: opensource.org/licenses/qpl
ipl :: ipl-1\\.0 :: ibm public :: opensource.org/licenses/ipl
apsl :: apsl-[12]\\.[012] :: apple public source :: opensource.apple.com/apsl
watcom :: watcom-1\\.0 :: (?:sybase )?open watcom public :: opensource.org/licenses/watcom
vim :: vim :: vim :: vimhelp.org/uganda
beerware :: beerware :: the beer-ware :: people.freebsd.org/~phk
json :: json :: json :: json.org/license
ruby-bsd :: bsd-2-clause-ruby :: ruby bsdl :: ruby-lang.org/en/about/license.bsdl
"""

# Label :: a phrase of the license's own text or notice. Blanks match any run of blanks and comment signs.
TEXTS = """
mit :: permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 :: permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files without any
isc :: permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
isc :: permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0bsd :: permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software is provided
bsd :: redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd :: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd :: redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
bsd-3 :: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-4 :: all advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes copyright
bsd-clear :: no express or implied licenses to any party's patent rights are granted by this license
apache :: licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license
apache :: unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
apache :: each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce
gpl :: this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license
gpl :: this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license
gpl :: everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
gpl :: the gnu general public license is a free, copyleft license for software and other kinds of works
gpl :: the licenses for most software are designed to take away your freedom to share and change it
lgpl :: this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license
lgpl :: this library is free software; you can redistribute it and/or modify it under the terms of the gnu library general public license
lgpl :: this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl :: it under the terms of the gnu affero general public license as published by the free software foundation
agpl :: the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation
gfdl :: permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
mpl :: this source code form is subject to the terms of the mozilla public license
mpl :: the contents of this file are subject to the mozilla public license version
npl :: the contents of this file are subject to the netscape public license version
epl :: this program and the accompanying materials are made available under the terms of the eclipse public license
epl :: the accompanying program is provided under the terms of this eclipse public license
cpl :: this program and the accompanying materials are made available under the terms of the common public license
cddl :: the contents of this file are subject to the terms of the common development and distribution license
zlib :: permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely
zlib :: altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution or licen
bsl :: permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense :: anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws
unlicense :: we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
cc0 :: to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
cc0 :: the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law
cc-by :: this work is licensed under a creative commons attribution
cc-by :: you are free to share copy and redistribute the material in any medium or format
cc-by-nc :: you may not use the material for commercial purposes under this license
cc-by-nd :: if you remix, transform, or build upon the material, you may not distribute the modified material under this license
cc-by-sa :: you must distribute your contributions under the same license as the original
wtfpl :: everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
artistic :: the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control
artistic :: everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. preamble this license establishes the terms under which a given free software package may be copied
ofl :: this font software is licensed under the sil open font license
ofl :: permission is hereby granted, free of charge, to any person obtaining a copy of the font software, to use, study, copy, merge, embed, modify, redistribute, and sell
psf :: psf hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly
python :: cnri grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test
php :: this product includes php software, freely available from http://www.php.net/software/ under the php license
openssl :: this product includes software developed by the openssl project for use in the openssl toolkit under this license
postgresql :: permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
ncsa :: permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal with the software without restriction
x11 :: except as contained in this notice, the name of the x consortium shall not be used in advertising or otherwise to promote the sale without prior written permission
curl :: permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
hpnd :: permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted
tcl :: the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose
ruby :: you may make and give away verbatim copies of the source form of the software without restriction, provided that you duplicate all of the original copyright notices
vim :: there are no restrictions on distributing unmodified copies of vim except that they must include this license text
json :: the software shall be used for good, not evil, under this license
beerware :: as long as you retain this notice you can do whatever you want with this stuff. if we meet some day, and you think this stuff is worth it, you can buy me a beer under this license
elastic :: you may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features licen
sspl :: if you make the functionality of the program or a modified version available to third parties as a service, you must make the service source code available under this license
bus :: the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
eupl :: licensed under the eupl, version
ms-pl :: this license governs use of the accompanying software. if you use the software, you accept this license
upl :: subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data
llama :: is licensed under the llama 2 community license, copyright meta platforms
proprietary :: all rights reserved. unauthorized copying of this file, via any medium is strictly prohibited copyright
proprietary :: this software is the confidential and proprietary information of its copyright owner
"""
#: Every phrase above holds one of these, which is looked for first.
STEMS = ("permission", "licen", "redistribut", "copyright")

#: Words after "license" that make it no software license.
_NOT = r"(?!\s+(?:plate|number|holder|fee|key|server)s?\b)"
_STATED = r"(?:licen[cs]ed|released|distributed|available|published|covered|provided)\s+under\s"

#: Forms in order of priority: name, certainty, pattern. {tag}, {name} and {address} come from the table.
FORMS = (
    ("tag", 1.0, r"spdx-license-identifier:\s*{tag}(?![\w.-])"),
    ("address", 0.95, r"https?://(?:www\.)?{address}[\w./-]*"),
    ("statement", 0.9, _STATED + r"+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{name}(?![\w-])(?:[\s-]+licen[cs]e)?(?:,?\s+(?:version\s+|v)?\d(?:\.\d)*)?"),
    ("title", 0.7, r"(?<![\w-]){name}[\s-]+licen[cs]e" + _NOT + r"(?:,?\s+(?:version\s+|v)?\d(?:\.\d)*)?"),
    ("short", 0.5, r"(?<![\w.-]){tag}(?![\w.-])(?=[^.\n]{{0,80}}licen\w*\b" + _NOT + ")"),
)
# The short form of tags that are words of a language as well (mit, json, ruby): the word license follows at once, or
# behind other names and what joins them.
_SHORT_WORD = r"(?<![\w.-]){tag}(?![\w.-])(?=(?:[\s,/&]+(?:or|and|style|compatible|dual|[\w.-]*(?:gpl|bsd|apache|mpl|mit|x11|isc)[\w.-]*))*[\s,/-]+licen\w*\b" + _NOT + ")"
_BLANKS = r"[\s*#/]+"


#: What every match of a form contains, as a condition on the lower-cased text.
ASKS = {
    "text": lambda low: functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in STEMS)),
    "tag": lambda low: F.contains(low, F.lit("spdx-license-identifier:")),
    "address": lambda low: F.contains(low, F.lit("http")),
    "statement": lambda low: F.contains(low, F.lit("under")) & low.rlike(_STATED),
    "title": lambda low: F.contains(low, F.lit("licen")),
    "short": lambda low: F.contains(low, F.lit("licen")),
}


def gate(pattern: str) -> str:
    """The longest literal, without blanks, that every match of a pattern of the table contains."""
    pattern = re.sub(r"\\(.)", lambda m: chr(0xE000 + ord(m[1])), pattern)
    while (less := re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\??", " ", pattern)) != pattern:
        pattern = less
    plain = re.sub("[\ue000-\ue07f]", lambda m: chr(ord(m[0]) - 0xE000), re.sub(r".\?", " ", pattern))
    return max(plain.split(), key=len)


def rules() -> list[tuple[int, str, str, list[str], str, float]]:
    """``(priority, label, form, gates, pattern, certainty)``; lower numbers win. Every match contains one of the gates."""
    out = []
    # Longer phrases are more particular and come first.
    for line in sorted(TEXTS.strip().splitlines(), key=len, reverse=True):
        label, phrase = line.split(" :: ")
        words = phrase.split()
        longest = max((re.sub(r"^\W+|\W+$", "", w) for w in words), key=len)
        out.append((len(out), label, "text", [longest], "(?i)" + _BLANKS.join(map(re.escape, words)), 0.98))
    for form, certainty, pattern in FORMS:
        for line in LICENSES.strip().splitlines():
            label, tag, names, address = line.split(" :: ")
            name = "(?:" + "|".join(n.replace(" ?", r"\s*").replace(" ", r"\s+") for n in names.split(";")) + ")"
            plain = form == "short" and not re.search(r"[\d-]", tag)
            text = (_SHORT_WORD if plain else pattern).format(tag=f"(?:{tag})", name=name, address=address.replace(".", r"\."))
            gates = {"tag": [gate(tag)], "short": [gate(tag)], "address": [address]}.get(form) or sorted(map(gate, names.split(";")))
            out.append((len(out), label, form, gates, f"(?i){text}", certainty))
    return out


def _phrase() -> str:
    """One pattern for all base phrases; none of them can overlap another."""
    one = "|".join(_GAP.join(p.split()) for p in BASE)
    return f"(?i)(?<!{_WORD})(?:{one})(?!{_WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def base_counts(rows: DataFrame) -> DataFrame:
    """Packed rows with the columns of the base count; ``base`` holds the labels found.

    The phrases all hold the word license, which gates their search. The steps are kept apart so that none is evaluated twice.
    """
    text, phrase = F.col("__text"), _phrase()
    gated = rows.withColumn("__gate", F.contains(F.lower(text), F.lit("license")))
    counted = gated.withColumns({"n_words": _count(text, f"{_WORD}+"), "n_base": F.when(F.col("__gate"), _count(text, phrase)).otherwise(F.lit(0).cast("long"))})
    some = F.col("n_base") > 0
    before = lambda greedy: F.when(some, _count(F.regexp_extract(text, rf"(?s)^(.*{greedy}){phrase}", 1), f"{_WORD}+"))
    found = [F.when(some & text.rlike(rf"(?i)(?<!{_WORD}){_GAP.join(p.split())}(?!{_WORD})"), F.lit(label)) for p, label in BASE.items()]
    return counted.withColumns({"first_word": before("?"), "last_word": before(""), "base": F.array_compact(F.array(*found))})


def detections(rows: DataFrame, spark: SparkSession, gated: bool = True) -> DataFrame:
    """``__rid, priority, label, certainty, start, end`` of what is left after suppression. Tests run it without gates."""
    table = spark.createDataFrame(rules(), "priority int, label string, form string, gates array<string>, pattern string, certainty double")
    low = F.col("low")
    cand = rows.select("__rid", "__text")
    if gated:
        forms = F.array_compact(F.array(*(F.when(asks(low), F.lit(form)) for form, asks in ASKS.items())))
        asked = rows.select("__rid", "__text", F.lower("__text").alias("low")).withColumn("forms", forms).where(F.size("forms") > 0)
        groups = sorted({(form, tuple(gates)) for _, _, form, gates, _, _ in rules()})
        every = F.array(*(F.struct(F.lit(f).alias("form"), F.array(*map(F.lit, g)).alias("gates")) for f, g in groups))
        present = F.filter(every, lambda g: F.array_contains("forms", g["form"]) & F.exists(g["gates"], lambda w: F.contains(low, w)))
        # The rule table is a constant of some 420 rows, so it is broadcast.
        cand = asked.select("__rid", "__text", F.explode(present).alias("g")).select("__rid", "__text", "g.*").join(F.broadcast(table), ["form", "gates"])
    else:
        cand = cand.crossJoin(F.broadcast(table))
    cand = cand.withColumn("m", F.regexp_extract_all("__text", F.col("pattern"), F.lit(0))).where(F.size("m") > 0)
    # Offsets of the matches: lengths of the gaps between them, which a split at the same pattern gives, and of themselves.
    cand = cand.withColumn("gap", F.split("__text", F.col("pattern"), -1))
    ends = F.transform("m", lambda _, i: F.aggregate(F.slice("gap", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("m", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)))
    found = cand.select("__rid", "priority", "label", "certainty", F.explode(F.arrays_zip(F.col("m"), ends.alias("end"))).alias("d"))
    found = found.select("__rid", "priority", "label", "certainty", (F.col("d.end") - F.length("d.m")).alias("start"), "d.end")
    return suppressed(found)


def suppressed(found: DataFrame) -> DataFrame:
    """``found`` without what lies within another detection, and of neighbours that overlap in part the one of lower priority.

    What is left of the first step has rising starts and ends; each detection is compared with the one before and after it.
    """
    w = Window.partitionBy("__rid").orderBy("start", F.desc("end"), "priority")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outer = found.withColumn("reach", reach).where("reach is null or reach < end")
    w = Window.partitionBy("__rid").orderBy("start")
    near = F.struct("start", "end", "priority")
    outer = outer.withColumns({"before": F.lag(near).over(w), "after": F.lead(near).over(w)})
    beaten = ((F.col("before.end") > F.col("start")) & (F.col("before.priority") < F.col("priority"))) | ((F.col("after.start") < F.col("end")) & (F.col("after.priority") < F.col("priority")))
    return outer.where(~F.coalesce(beaten, F.lit(False))).drop("reach", "before", "after")


def license_report(docs: DataFrame) -> DataFrame:
    rows = packed(docs)
    kept = detections(rows, docs.sparkSession).groupBy("__rid").agg(F.collect_set("label").alias("found"), F.max("certainty").alias("certainty"), F.count("*").alias("n_detections"))
    base = base_counts(rows).select("__rid", F.col("__row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    none = F.array().cast("array<string>")
    return base.join(kept, "__rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined("base").alias("base_labels"),
        joined(F.array_union("base", F.coalesce("found", none))).alias("labels"),
        F.greatest(F.coalesce("certainty", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
    )
