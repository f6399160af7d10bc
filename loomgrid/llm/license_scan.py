"""Licence scan by sentence rules, in DataFrame expressions only.

A text is cut into pieces after `.`, `!` and `?` and at blank lines (comment marks alone leave a line blank); a piece is
a sentence, however its lines are wrapped. Each sentence is normalised (runs of other than letters and digits become
one blank, lower case, and what says that a work is licensed under something becomes `under`) and mapped to the
identifier of a known licence sentence, or to 0. Headings often stand before a sentence without a mark between: where a
piece is not known, it is read as its first lines and the longest run of last lines that is known, else line by line if
a line is known, else as one sentence. The sequence of identifiers is then matched against licence rules in order: a
rule names a licence and the consecutive identifiers it needs. A rule that matches consumes its identifiers, so that a
later, more general rule does not match them again.

Cases: null or empty text has no sentences and no licence. A licence stated twice is listed once. Licence-like
sentences without an identifier are counted as unknown. Equal rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Where texts are cut, after `v. 2` is written `v 2`.
CUT = r"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D#*/;-]*\n|[.!?]+$"
SHORT_V = r"([^A-Za-z0-9])[vV]\.[\x20\x09-\x0D]+"
HINT = "licen[sc]e|copyright|warrant"
#: What every known sentence holds; texts and pieces without it need no closer look.
MARK = "licen[sc]|permission|redistribut|software|(?:^|[^a-z0-9])under[^a-z0-9]"
#: How a work is said to be licensed, in normalised sentences (fixed value).
STATED = r"^(?:(?:this|the)(?: [a-z]+){1,3} (?:is|are) )?(?:made )?(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a |an )?"
#: Last lines of a piece that are tried as one sentence.
LINES = 24

# Normalised sentences of well-known licence texts, with their identifiers. Those of one identifier say the same.
SENTENCES = (
    (1, "under apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (2, "you may obtain a copy of the license at"),
    (2, "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    (3, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (4, "see the license for the specific language governing permissions and limitations under the license"),
    (5, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (6, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (7, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (8, "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    (9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (10, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (11, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (12, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (13, "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (14, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (15, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (16, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    (17, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    (18, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    (19, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (20, "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (21, "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules and to copy and distribute the resulting executable under terms of your choice provided that you also meet for each linked independent module the terms and conditions of the license of that module"),
    (22, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (23, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (24, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (25, "this is free and unencumbered software released into the public domain"),
    (26, "this software is provided as is without any express or implied warranty"),
    (27, "in no event will the authors be held liable for any damages arising from the use of this software"),
    (28, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    (29, "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    (30, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
)

# Rules on licence texts in the order in which they are tried: licence and consecutive sentence identifiers.
TEXT_RULES = (
    ("GPL-2.0-with-classpath-exception", (14, 21)),
    ("Apache-2.0", (1, 2, 3, 4)),
    ("Apache-2.0", (1, 2)),
    ("Apache-2.0", (1,)),
    ("MIT", (5, 6, 7, 8)),
    ("MIT", (5, 6)),
    ("MIT", (5,)),
    ("BSD-3-Clause", (9, 10, 11, 12)),
    ("BSD-3-Clause", (9, 12)),
    ("BSD-2-Clause", (9, 10, 11)),
    ("BSD-2-Clause", (9,)),
    ("GPL-2.0-or-later", (14,)),
    ("GPL-3.0-or-later", (15,)),
    ("GPL-2.0", (16,)),
    ("GPL-3.0", (17,)),
    ("LGPL-2.1-or-later", (18,)),
    ("LGPL-3.0-or-later", (19,)),
    ("AGPL-3.0-or-later", (20,)),
    ("MPL-2.0", (22,)),
    ("ISC", (23,)),
    ("0BSD", (24,)),
    ("Unlicense", (25,)),
    ("Zlib", (26, 27, 28)),
    ("Zlib", (28,)),
    ("EPL-2.0", (29,)),
    ("BSL-1.0", (30,)),
)

# Names of licences as they are stated, normalised.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"),
    "MIT": ("mit license", "mit licence", "mit"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public licence v1 2", "eupl 1 2"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "Artistic-2.0": ("artistic license 2 0",),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
}
GNU = {"GPL": ("general public license", ("2", "3")), "LGPL": ("lesser general public license", ("2.1", "3")), "AGPL": ("affero general public license", ("3",))}
LATER = ("or later", "or any later version", "or at your option any later version")
CC_PARTS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = {"2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}


def _plain(name: str) -> str:
    return name.lower().replace(".", " ").replace("-", " ")


def names() -> dict[str, list[str]]:
    """The names of each licence; those of the GNU and Creative Commons families are put together from their parts."""
    out = {k: list(v) for k, v in NAMES.items()}
    for short, (long, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            forms = [f"{g}{n} {mark}{_plain(x)}" for g, n in (("gnu ", long), ("gnu ", short.lower()), ("", long), ("", short.lower())) for mark in ("version ", "v", "") for x in dict.fromkeys((v, full))]
            forms += [f"{g}{short.lower()}v{_plain(v)}" for g in ("", "gnu ")]
            out[f"{short}-{full}"] = forms
            out[f"{short}-{full}-or-later"] = [f"{x} {y}" for x in forms for y in LATER]
    for kind in CC_KINDS:
        words = " ".join(CC_PARTS[x] for x in kind.split("-"))
        for v, port in CC_VERSIONS.items():
            out[f"CC-{kind}-{v}"] = [f"{x} {_plain(v)}{end}" for x in (f"cc {_plain(kind)}", f"creative commons {_plain(kind)}", f"creative commons {words}") for end in ("", f" {port}")]
    return out


def known_sentences() -> tuple[list[str], list[int], list[tuple[str, tuple[int, ...]]]]:
    """All known sentences, their identifiers, and the rules in order: those on texts, then one for each licence stated by name."""
    found = {s: i for i, s in SENTENCES}
    rules = list(TEXT_RULES)
    number = max(found.values())
    for licence, forms in names().items():
        number += 1
        rules.append((licence, (number,)))
        for form in forms:
            for end in ("",) if form.endswith(("license", "licence")) else ("", " license"):
                found.setdefault(f"under {form}{end}", number)
        spdx = [licence, f"{licence}-only"] if licence.split("-")[0] in GNU and not licence.endswith("later") else [licence]
        for x in spdx:
            found.setdefault(f"spdx license identifier {_plain(x)}", number)
    return list(found), list(found.values()), rules


KEYS, NUMBERS, RULES = known_sentences()


def _ids(sequence: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in sequence)


def _clean(s: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def _normal(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(" under ")) | s.rlike("^[a-z]+ under "), F.regexp_replace(s, STATED, "under ")).otherwise(s)


_LONGEST = max(map(len, KEYS)) + 80


def _known(s: Column) -> Column:
    return (F.length(s) <= _LONGEST) & _normal(s).isin(KEYS)


def _sentences_in(piece: Column) -> Column:
    """The sentences of a piece, as the head of this module says."""
    lines = F.filter(F.transform(F.split(piece, "\n"), _clean), lambda x: x != "")

    def read(x: Column) -> Column:
        whole, n = F.array_join(x, " "), F.size(x)
        tail = lambda i: F.array_join(F.slice(x, i, n), " ")
        starts = F.filter(F.sequence(F.greatest(F.lit(2), n - LINES), n), lambda i: _known(tail(i)))
        by_tail = lambda s: F.when(s.isNotNull(), F.concat(F.slice(x, 1, s - 1), F.array(tail(s)))).when(F.exists(x, _known), x).otherwise(F.array(whole))
        return F.when(n == 0, F.array().cast("array<string>")).when((n == 1) | _known(whole), F.array(whole)).otherwise(let(F.get(starts, F.lit(0)), by_tail))

    return F.when(piece.rlike(f"(?i){MARK}"), let(lines, read)).otherwise(F.filter(F.array(_clean(piece)), lambda x: x != ""))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, n_unknown of every document."""
    keys, numbers = F.lit(KEYS), F.lit(NUMBERS)
    number = lambda s: F.when(_known(s), F.get(numbers, (F.array_position(keys, _normal(s)) - 1).cast("int"))).otherwise(0)

    def matched(ids: Column, rules: list[tuple[str, str]]) -> Column:
        """Rules in order; each that is found is listed and its identifiers are consumed."""
        table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(seq).alias("seq")) for name, seq in rules])
        none = F.struct(ids.alias("rest"), F.lit("").alias("found"))

        def step(acc: Column, rule: Column) -> Column:
            more = F.when(F.contains(F.concat(F.lit(","), acc["found"], F.lit(",")), F.concat(F.lit(","), rule["name"], F.lit(","))), acc["found"]).otherwise(
                F.when(acc["found"] == "", rule["name"]).otherwise(F.concat(acc["found"], F.lit(","), rule["name"]))
            )
            hit = F.struct(F.replace(acc["rest"], rule["seq"], F.lit("<0>")).alias("rest"), more.alias("found"))
            return F.when(F.contains(acc["rest"], rule["seq"]), hit).otherwise(acc)

        return F.aggregate(table, none, step, lambda acc: acc["found"])

    def scan(s: Column) -> Column:
        def found(n: Column) -> Column:
            ids = F.concat(F.lit("<"), F.array_join(F.transform(n, lambda x: x.cast("string")), "><"), F.lit(">"))
            kept = F.filter(n, lambda x: x > 0)
            unknown = F.filter(s, lambda x, i: x.rlike(HINT) & (F.get(n, i) == 0))
            return F.struct(
                F.size(s).cast("long").alias("n_sentences"),
                F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("sentence_ids"),
                F.when(F.size(kept) == 0, "").otherwise(let(ids, lambda i: matched(i, [(name, _ids(seq)) for name, seq in RULES]))).alias("licenses"),
                F.size(unknown).cast("long").alias("n_unknown"),
            )

        return let(F.transform(s, number), found)

    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SHORT_V, "$1v ")
    closer = let(F.flatten(F.transform(F.split(text, CUT), _sentences_in)), scan)
    count = F.size(F.filter(F.split(text, CUT), lambda x: x.rlike("[A-Za-z0-9]"))).cast("long")
    plain = F.struct(count.alias("n_sentences"), F.lit("").alias("sentence_ids"), F.lit("").alias("licenses"), F.lit(0).cast("long").alias("n_unknown"))
    return docs.select("doc_id", F.when(F.col("text").rlike(f"(?i){MARK}|{HINT}"), closer).otherwise(plain).alias("_s")).select("doc_id", "_s.*")


def oracle() -> str:
    """The same by DuckDB."""
    known = ", ".join(f"('{s}', {i})" for s, i in zip(KEYS, NUMBERS))
    rests = ",\n ".join(f"replace(q{k}, '{_ids(seq)}', '<0>') AS q{k + 1}, contains(q{k}, '{_ids(seq)}') AS f{k}" for k, (_, seq) in enumerate(RULES))
    licences = list(dict.fromkeys(name for name, _ in RULES))
    first = lambda name: [k for k, (x, _) in enumerate(RULES) if x == name]
    order = ", ".join(f"CASE {' '.join(f'WHEN f{k} THEN {k}' for k in first(name))} END" for name in licences)
    listed = ", ".join(f"'{name}'" for name in licences)
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '{SHORT_V}', '\1v ', 'g') AS t FROM documents),
p AS (SELECT rid, regexp_split_to_array(t, '{CUT}') AS pieces FROM d),
l AS (SELECT rid, i, list_filter(list_transform(string_split(pieces[i], chr(10)), lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))), lambda x: x <> '') AS lines
      FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM p)),
x AS (SELECT *, len(lines) AS n FROM l WHERE len(lines) > 0),
c AS (SELECT rid, i, j, array_to_string(lines[j:], ' ') AS s FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM x) WHERE j = 1 OR j >= greatest(2, n - {LINES})),
b AS (SELECT rid, i, min(j) AS j FROM c JOIN known ON known.s = regexp_replace(c.s, '{STATED}', 'under ') GROUP BY rid, i),
a AS (SELECT DISTINCT rid, i FROM (SELECT rid, i, unnest(lines) AS s FROM x) y JOIN known ON known.s = regexp_replace(y.s, '{STATED}', 'under ')),
z AS (SELECT x.rid, x.i, CASE WHEN b.j IS NOT NULL THEN list_concat(lines[:b.j - 1], [array_to_string(lines[b.j:], ' ')]) WHEN a.rid IS NOT NULL THEN lines ELSE [array_to_string(lines, ' ')] END AS ss
      FROM x LEFT JOIN b ON b.rid = x.rid AND b.i = x.i LEFT JOIN a ON a.rid = x.rid AND a.i = x.i),
e AS (SELECT rid, i, o, ss[o] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS o FROM z)),
f AS (SELECT e.rid, i, o, e.s, coalesce(id, 0) AS id FROM e LEFT JOIN known ON known.s = regexp_replace(e.s, '{STATED}', 'under ')),
n AS (SELECT rid, count(*) AS n_sentences, list(id ORDER BY i, o) AS n, count(*) FILTER (WHERE id = 0 AND regexp_matches(s, '{HINT}')) AS n_unknown FROM f GROUP BY rid),
m AS (SELECT * FROM n WHERE list_max(n) > 0),
q AS (SELECT rid, '<' || array_to_string(n, '><') || '>' AS q0 FROM m),
r AS (SELECT *, {rests} FROM q),
o AS (SELECT rid, list_filter(list_zip([{order}], [{listed}]), lambda x: x[1] IS NOT NULL) AS o FROM r)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(array_to_string(list_filter(n.n, lambda x: x > 0), ','), '') AS sentence_ids,
       coalesce(array_to_string(list_transform(list_sort(o.o), lambda x: x[2]), ','), '') AS licenses, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN o ON o.rid = d.rid
"""
