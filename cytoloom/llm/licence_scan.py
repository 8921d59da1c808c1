"""Operator 8. License scans by sentence rules, in DataFrame functions only.

Comment marks at line starts are removed. A text is cut into sentences in two ways: at each line end, and at blank lines only, so that wrapped
lines are joined; both cut after . ! ? ; : before white space as well. Each sentence is normalised (A-Z in lower case, runs of characters other than a-z and 0-9
become one blank, names of holders in standard clauses become one word) and looked up among known licence sentences; a sentence that puts
something under a licence by name ("is licensed under the MIT License") has the identifier of that licence's references. The identifiers found,
in order, form a string in which ordered rules are searched: a rule's sentences must follow each other among the recognised ones. A rule
that stands inside a longer one that matched (BSD-2-Clause in BSD-3-Clause) counts only where it stands alone. SPDX lines are read as expressions,
whatever identifiers they hold. No row is exploded before a rule has matched, so the scan needs no shuffle whatever the table holds.

Null and empty texts match nothing and give no rows, as does an empty table. Repeated rows are each reported, with a null doc_id too. Of rules for one
licence the longest that matches is reported (its sentences and how often it occurs); of equally long ones the first by name. Texts of any length
are scanned whole. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Forms of the GNU headers, by name of the rule.
_GNU_FORMS = {
    "header": "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    "header_old": "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.",
    "only": "you can redistribute it and/or modify it under the terms of version {1} of the GNU {0} Public License as published by the Free Software Foundation.",
    "only_kernel": "you can redistribute it and/or modify it under the terms of the GNU {} Public License version {} as published by the Free Software Foundation.",
}
#: Licence sentences by identifier.
SENTENCES: dict[str, str] = {
    "apache_1": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_2": "you may not use this file except in compliance with the License.",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache_title": "Version 2.0, January 2004",
    "mit_permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc_permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_permission_old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd_permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd_product": "This product includes software developed by the holder.",
    "bsd_names": "Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost_permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mpl2_terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2_title": "Mozilla Public License Version 2.0",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0_title": "CC0 1.0 Universal",
    "cc0_law": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "gpl_title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl_title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl_title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "v2_date": "Version 2, June 1991",
    "v21_date": "Version 2.1, February 1999",
    "v3_date": "Version 3, 29 June 2007",
    "agpl_date": "Version 3, 19 November 2007",
}
#: Rule, licence, its sentences in order.
RULES: list[tuple[str, str, list[str]]] = [
    ("apache2_line", "Apache-2.0", ["apache_1"]),
    ("apache2_header", "Apache-2.0", ["apache_1", "apache_2"]),
    ("apache2_text", "Apache-2.0", ["apache_title", "apache_terms"]),
    ("mit_text", "MIT", ["mit_permission", "mit_notice", "mit_as_is"]),
    ("mit_0_text", "MIT-0", ["mit_0_permission", "mit_as_is"]),
    ("isc_text", "ISC", ["isc_permission"]),
    ("isc_text_old", "ISC", ["isc_permission_old"]),
    ("0bsd_text", "0BSD", ["0bsd_permission"]),
    ("bsd1_text", "BSD-1-Clause", ["bsd_redistribution", "bsd_source"]),
    ("bsd2_text", "BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("bsd3_text", "BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names"]),
    ("bsd4_text", "BSD-4-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_product", "bsd_names"]),
    ("zlib_text", "Zlib", ["zlib_as_is", "zlib_permission"]),
    ("boost_text", "BSL-1.0", ["boost_permission"]),
    ("mpl2_header", "MPL-2.0", ["mpl2_terms"]),
    ("mpl2_text", "MPL-2.0", ["mpl2_title"]),
    ("unlicense_text", "Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("cc0_text", "CC0-1.0", ["cc0_title"]),
    ("cc0_line", "CC0-1.0", ["cc0_law"]),
    ("gpl2_text", "GPL-2.0", ["gpl_title", "v2_date"]),
    ("gpl3_text", "GPL-3.0", ["gpl_title", "v3_date"]),
    ("lgpl21_text", "LGPL-2.1", ["lgpl_title", "v21_date"]),
    ("lgpl3_text", "LGPL-3.0", ["lgpl_title", "v3_date"]),
    ("agpl3_text", "AGPL-3.0", ["agpl_title", "agpl_date"]),
]
SENTENCES["mit_0_permission"] = SENTENCES["mit_permission"].replace(", subject to the following conditions:", ".")
#: Family, its full name, its versions.
GNU = [("GPL", "General", ["1", "2", "3"]), ("LGPL", "Lesser General", ["2.1", "3"]), ("LGPL", "Library General", ["2"]), ("AGPL", "Affero General", ["3"])]
for _short, _long, _versions in GNU:
    for _v in _versions:
        _name = f"{_short.lower()}{_v}"
        _id = f"{_short}-{_v if '.' in _v else _v + '.0'}"
        for _form, _text in _GNU_FORMS.items():
            SENTENCES[f"{_name}_{_form}"] = _text.format(_long, _v)
            RULES.append((f"{_name}_{_form}", f"{_id}-{'or-later' if 'later' in _text else 'only'}", [f"{_name}_{_form}"]))

#: Names by which a sentence refers to a licence, normalised.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache licence version 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0", "apache version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "2 clause bsd", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license"],
    "ISC": ["isc license", "isc licence"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0", "mplv2"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero"],
}
for _short, _long, _versions in GNU:
    for _v in _versions:
        _n, _w = _v.replace(".", " "), f"gnu {_long.lower()} public license"
        NAMES.setdefault(f"{_short}-{_v if '.' in _v else _v + '.0'}", []).extend(
            [f"{_w} {x}{_n}" for x in ("version ", "v", "v ", "")] + [f"{y}{_short.lower()}{x}{_n}" for x in (" version ", " v", "v", " ", "") for y in ("", "gnu ")] + [f"{_short.lower()} {_n} 0"] * (" " not in _n)
        )
#: Parts of Creative Commons names.
_CC = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
for _parts in (["by"], ["by", "sa"], ["by", "nc"], ["by", "nd"], ["by", "nc", "sa"], ["by", "nc", "nd"]):
    for _v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
        _w = [f"creative commons {' '.join(_CC[x] for x in _parts)}", f"cc {' '.join(_parts)}", f"creative commons {' '.join(_parts)}"]
        NAMES[f"CC-{'-'.join(_parts).upper()}-{_v.replace(' ', '.')}"] = [f"{w} {_v}" for w in _w] + [f"{w} license {_v}" for w in _w]
RULES += [(f"ref_{k}", k, [f"ref:{k}"]) for k in NAMES]

#: Comment marks at the start of a line; how a sentence puts something under a licence; wording with names of holders.
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|dnl |REM |rem |!+|>+|\|+)[ \t]*"
REFER = r"(?:^|.* )(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|shared) (?:under|by) (?:a |an |the )?(?:terms of )?(?:a |an |the )?(?:terms and conditions of the )?"
HOLDERS = [
    (r"^neither the names? of .+ nor the names of (?:its|their|his|her|the|any) contributors may be used", "neither the name of the holder nor the names of its contributors may be used"),
    (r"^neither the name of .+ nor the name of .+ may be used", "neither the name of the holder nor the names of its contributors may be used"),
    (r"^(?:the name|the names) of .+ may not be used to endorse", "neither the name of the holder nor the names of its contributors may be used to endorse"),
    (r"^this product includes software developed by .+", "this product includes software developed by the holder"),
    (r"^(?:[0-9]{1,2}|[a-d]|i{1,3}) (redistribut|all advert|neither)", r"\1"),
    (r"^to the extent possible under law .+ dedicated all copyright", "to the extent possible under law the author s have dedicated all copyright"),
]
ENDS = r"[.!?;:][\"'”’)]*"
CUTS = {"lines": rf"\n|{ENDS}[ \t\r]+", "paragraphs": rf"\n[ \t\r]*\n[ \t\r\n]*|{ENDS}[ \t\r\n]+"}
SPDX = r"(?i:SPDX-License-Identifier):[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
#: A text without any of these holds no known sentence and no SPDX line (a test checks it).
GATE = r"(?i)licen[sc]|permi|redistribut|provided|public|advertising|neither|names? of|product includes|anyone is free|cc0|version [23]|reproduction|(?:released|distributed|available|published|covered|governed|shared)[^a-z0-9]+(?:under|by)[^a-z0-9]"


def normal(s: str) -> str:
    s = re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")
    return reduce(lambda x, h: re.sub(*h, x), HOLDERS, s)


@cache
def known() -> dict[str, str]:
    """Normalised sentence to identifier. A text that the cuts divide is known by its parts, numbered; a part that several texts share has one identifier."""
    out: dict[str, str] = {}
    for name, text in SENTENCES.items():
        parts = [x for x in map(normal, re.split(CUTS["lines"], text)) if x]
        for i, x in enumerate(parts):
            out.setdefault(x, name if len(parts) == 1 else f"{name}.{i}")
    return out


def sequence(name: str) -> list[str]:
    """Identifiers of a known text's sentences, or of a reference."""
    return [known()[x] for x in map(normal, re.split(CUTS["lines"], SENTENCES[name])) if x] if name in SENTENCES else [name]


def names() -> dict[str, str]:
    """Licence names to licences, longest first, so that a pattern of alternatives takes the longest."""
    return dict(sorted(((n, k) for k, v in NAMES.items() for n in v), key=lambda x: (-len(x[0]), x[0])))


def _reference() -> str:
    return rf"{REFER}({'|'.join(names())})(?: .*|$)"


def inside() -> dict[str, list[str]]:
    """The shortest rules that hold a rule's whole sequence among more."""
    flat = {r: " " + "  ".join(x for n in s for x in sequence(n)) + " " for r, _, s in RULES}
    out = {a: [b for b in flat if a != b and flat[a] in flat[b]] for a in flat}
    return {a: [b for b in bs if not any(b in out[c] for c in bs)] for a, bs in out.items()}


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def identifiers(text: Column, cut: str) -> Column:
    """The recognised sentences of a text, in order. Cheap tests come before the map look-up, which is linear."""
    ids, refs, pattern = known(), names(), _reference()

    def clean(s: Column) -> Column:
        s = F.trim(F.regexp_replace(_lower(s), "[^a-z0-9]+", " "))
        return reduce(lambda x, h: F.regexp_replace(x, h[0], h[1].replace("\\1", "$1")), HOLDERS, s)

    by_name = F.create_map(*[F.lit(x) for kv in refs.items() for x in kv])
    by_text = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    cuts = F.filter(F.split(text, cut), lambda s: F.length(s) >= 10)
    # a known sentence, else a reference, which holds " under " or " by "
    name = lambda s: F.when(s.isin(list(ids)), by_text[s]).when(s.rlike("(?:under|by) ") & s.rlike(pattern), F.concat(F.lit("ref:"), by_name[F.regexp_extract(s, pattern, 1)]))
    return F.filter(F.transform(F.transform(cuts, clean), name), lambda x: x.isNotNull())


def spdx(text: Column) -> Column:
    """Licences named by a text's SPDX lines, with repeats."""
    every = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda e: F.regexp_extract_all(F.regexp_replace(e, r"[ \t]+WITH[ \t]+[A-Za-z0-9.+-]+", ""), F.lit(r"([A-Za-z0-9][A-Za-z0-9.+-]*)"), 1)))
    return F.filter(F.transform(every, lambda x: F.regexp_replace(x, r"[.-]+$", "")), lambda x: ~x.isin("AND", "OR", "NONE", "NOASSERTION", ""))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, rule, n_sentences, n_found), a row for each licence that a document names."""
    text = F.col("text").cast("string")
    d = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike(GATE))
    bare = F.regexp_replace("text", COMMENT, "$1")
    seq = lambda cut: F.concat(F.lit(" "), F.array_join(identifiers(bare, cut), "  "), F.lit(" "))  # noqa: E731  each identifier between blanks of its own
    d = d.select("doc_id", *[seq(cut).alias(k) for k, cut in CUTS.items()], spdx(F.col("text")).alias("spdx")).where(" OR ".join([*(f"length({k}) > 2" for k in CUTS), "size(spdx) > 0"]))
    flat = {r: [x for n in s for x in sequence(n)] for r, _, s in RULES}
    times = lambda r: F.greatest(*[F.size(F.split(k, re.escape(f" {'  '.join(flat[r])} ").replace("\\ ", " "), -1)) - 1 for k in CUTS])
    longer, tests = inside(), []
    for rule, licence, _ in RULES:
        n = reduce(lambda x, r: x - times(r), longer[rule], times(rule))
        tests.append(F.when(n > 0, F.struct(F.lit(licence).alias("licence"), F.lit(len(flat[rule])).alias("n_sentences"), F.lit(rule).alias("rule"), n.alias("n_found"))))
    lines = F.transform(F.array_distinct("spdx"), lambda x: F.struct(x.alias("licence"), F.lit(1).alias("n_sentences"), F.lit("spdx").alias("rule"), F.size(F.filter("spdx", lambda y: y == x)).alias("n_found")))
    found = d.select("doc_id", F.concat(F.filter(F.array(*tests), lambda x: x.isNotNull()), lines).alias("f"))
    best = F.filter("f", lambda x: ~F.exists("f", lambda y: (y["licence"] == x["licence"]) & ((y["n_sentences"] > x["n_sentences"]) | ((y["n_sentences"] == x["n_sentences"]) & (y["rule"] < x["rule"])))))
    return found.select("doc_id", F.explode(best).alias("m")).select("doc_id", "m.licence", "m.rule", F.col("m.n_sentences").cast("long").alias("n_sentences"), F.col("m.n_found").cast("long").alias("n_found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ids = ", ".join(f"({q(k)}, {q(v)})" for k, v in known().items())
    refs = ", ".join(f"({q(k)}, {q(v)})" for k, v in names().items())
    flat = {r: " " + "  ".join(x for n in s for x in sequence(n)) + " " for r, _, s in RULES}
    rules = ", ".join(f"({q(r)}, {q(li)}, {q(flat[r])}, {sum(len(sequence(n)) for n in s)})" for r, li, s in RULES)
    holds = ", ".join(f"({q(a)}, {q(b)})" for a, bs in inside().items() for b in bs)
    clean = reduce(lambda x, h: f"regexp_replace({x}, {q(h[0])}, {q(h[1])})", HOLDERS, "trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ')")
    return f"""
WITH known(s, id) AS (VALUES {ids}), refs(s, licence) AS (VALUES {refs}), rules(rule, licence, pat, n_sentences) AS (VALUES {rules}), holds(a, b) AS (VALUES {holds}),
docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rn, text, regexp_replace(text, {q(COMMENT)}, '\\1', 'g') AS bare FROM documents WHERE text IS NOT NULL),
cut AS ({' UNION ALL '.join(f"SELECT rn, '{k}' AS way, regexp_split_to_array(bare, {q(c)}) AS a FROM docs" for k, c in CUTS.items())}),
s AS (SELECT rn, way, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM cut),
n AS (SELECT rn, way, i, {clean} AS s FROM s WHERE length(x) >= 10),
m AS (SELECT rn, way, i, coalesce(known.id, CASE WHEN regexp_matches(n.s, {q(_reference())}) THEN 'ref:' || (SELECT licence FROM refs WHERE refs.s = regexp_extract(n.s, {q(_reference())}, 1)) END) AS id FROM n LEFT JOIN known USING (s)),
d AS (SELECT rn, way, ' ' || string_agg(id, '  ' ORDER BY i) || ' ' AS seq FROM m WHERE id IS NOT NULL GROUP BY rn, way),
t AS (SELECT rn, rule, licence, n_sentences, max(len(string_split(seq, pat)) - 1) AS n FROM d JOIN rules ON contains(seq, pat) GROUP BY ALL),
o AS (SELECT t.rn, t.rule, sum(u.n) AS less FROM t JOIN holds ON holds.a = t.rule JOIN t u ON u.rule = holds.b AND u.rn = t.rn GROUP BY ALL),
e AS (SELECT rn, unnest(regexp_extract_all(text, {q(SPDX)}, 1)) AS e FROM docs),
i AS (SELECT rn, regexp_replace(unnest(regexp_extract_all(regexp_replace(e, '[ \\t]+WITH[ \\t]+[A-Za-z0-9.+-]+', '', 'g'), '[A-Za-z0-9][A-Za-z0-9.+-]*')), '[.-]+$', '') AS x FROM e),
f AS (SELECT rn, licence, rule, n_sentences, n - coalesce(less, 0) AS n_found FROM t LEFT JOIN o USING (rn, rule) WHERE n > coalesce(less, 0)
      UNION ALL SELECT rn, x, 'spdx', 1, count(*) FROM i WHERE x NOT IN ('AND', 'OR', 'NONE', 'NOASSERTION', '') GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY rn, licence ORDER BY n_sentences DESC, rule) AS k FROM f)
SELECT doc_id, licence, rule, n_sentences::BIGINT AS n_sentences, n_found::BIGINT AS n_found FROM b JOIN docs USING (rn) WHERE k = 1
"""
