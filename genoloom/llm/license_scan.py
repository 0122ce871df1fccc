"""Licence scan: known licence sentences, then ordered rules over their sequence. Native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences in normalised form (lower case, other characters than letters and digits as
#: one blank) and their identifiers.
SENTENCES = {
    "all rights reserved": "rights-reserved",
    # Apache
    "licensed under the apache license version 2 0": "apache-2-notice",
    "apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-grant",
    "you may not use this file except in compliance with the license": "apache-2-comply",
    "you may obtain a copy of the license at": "apache-2-copy",
    "spdx license identifier apache 2 0": "apache-2-tag",
    "apache license version 2 0 january 2004": "apache-2-title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-2-title",
    "apache license version 2 0 january 2004 https www apache org licenses": "apache-2-title",
    "spdx license identifier mit or apache 2 0": "mit-or-apache-2-tag",
    "spdx license identifier apache 2 0 or mit": "mit-or-apache-2-tag",
    # MIT
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-notice",
    "the mit license mit": "mit-notice",
    "mit license": "mit-notice",
    "spdx license identifier mit": "mit-tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-include",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "spdx license identifier bsd 2 clause": "bsd-2-tag",
    "spdx license identifier bsd 3 clause": "bsd-3-tag",
    # GNU
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software": "gpl-free",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "either version 2 of the license or at your option any later version": "later-2",
    "either version 2 1 of the license or at your option any later version": "later-2-1",
    "either version 3 of the license or at your option any later version": "later-3",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "you can redistribute it and or modify it under the same terms as perl itself": "perl-terms",
    "spdx license identifier gpl 2 0 only": "gpl-2-only-tag",
    "spdx license identifier gpl 2 0": "gpl-2-only-tag",
    "spdx license identifier gpl 2 0 or later": "gpl-2-later-tag",
    "spdx license identifier gpl 3 0 only": "gpl-3-only-tag",
    "spdx license identifier gpl 3 0": "gpl-3-only-tag",
    "spdx license identifier gpl 3 0 or later": "gpl-3-later-tag",
    "spdx license identifier lgpl 2 1 or later": "lgpl-2-1-later-tag",
    "spdx license identifier agpl 3 0 or later": "agpl-3-later-tag",
    # Creative Commons
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "this work is licensed under a creative commons attribution 3 0 unported license": "cc-by-3-notice",
    "this work is licensed under the creative commons attribution 3 0 unported license": "cc-by-3-notice",
    "licensed under cc by 3 0": "cc-by-3-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-waiver",
    "spdx license identifier cc0 1 0": "cc0-tag",
    # others
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "spdx license identifier mpl 2 0": "mpl-2-tag",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd-0-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl-1-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
}

#: Rules in order; a rule's sentences must follow each other among the known sentences of a
#: document, and a sentence that one rule has used is not open to later ones.
RULES = [
    ("Apache-2.0", ["apache-2-grant", "apache-2-comply", "apache-2-copy"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-include", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-include", "mit-warranty"]),
    ("MIT", ["mit-include", "mit-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "later-3"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "later-2"]),
    ("GPL-2.0-only", ["gpl-free", "gpl-2-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "later-2-1"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl-terms", "later-3"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl-3-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-3-later"]),
    ("MPL-2.0", ["mpl-2-notice", "mpl-2-copy"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["bsd-0-grant", "isc-warranty"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSL-1.0", ["bsl-1-grant"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ["lgpl-free", "perl-terms"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ["gpl-free", "perl-terms"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("GPL-3.0-only", ["gpl-3-title"]),
    ("GPL-2.0-only", ["gpl-2-title"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("MIT", ["mit-notice"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-3.0", ["cc-by-3-notice"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Unlicense", ["unlicense-notice"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("BSL-1.0", ["bsl-1-notice"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("MIT OR Apache-2.0", ["mit-or-apache-2-tag"]),
    ("Apache-2.0", ["apache-2-tag"]),
    ("MIT", ["mit-tag"]),
    ("BSD-2-Clause", ["bsd-2-tag"]),
    ("BSD-3-Clause", ["bsd-3-tag"]),
    ("GPL-2.0-only", ["gpl-2-only-tag"]),
    ("GPL-2.0-or-later", ["gpl-2-later-tag"]),
    ("GPL-3.0-only", ["gpl-3-only-tag"]),
    ("GPL-3.0-or-later", ["gpl-3-later-tag"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-later-tag"]),
    ("AGPL-3.0-or-later", ["agpl-3-later-tag"]),
    ("MPL-2.0", ["mpl-2-tag"]),
    ("CC0-1.0", ["cc0-tag"]),
    ("all-rights-reserved", ["rights-reserved"]),
]

#: What is done to a lower-case text, in turn, before it is cut: marks of comments and lists at a line's ends go, a
#: version's "v. 2" and a tag's colon keep their sentence whole, paragraphs end at blank lines, and whoever a clause
#: against endorsement names is its holder. (Pattern, by what.)
PREPARED = [
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|%+|--+|<!--+|[•·-]|\(?[0-9a-z][.)])[ \t]*){1,3}", "$1"),
    (r"(?:\*{1,3}/|-{2,3}>)[ \t]*(\n|$)", "$1"),
    (r"(spdx-license-identifier):[ \t]*", "$1 "),
    (r"([.:])[ \t]+([0-9])", "$1$2"),
    (r"\n[ \t]*\n[ \t\n]*", "\f"),
    (r"neither[ \t\n]+the[ \t\n]+names?[ \t\n]+of[ \t\n]+[^\f]+?[ \t\n]+nor[ \t\n]+the[ \t\n]+names?[ \t\n]+of[ \t\n]+(?:its|any|the|their)[ \t\n]+contributors", "neither the name of the copyright holder nor the names of its contributors"),
]
#: A sentence ends at . ! ? ; : followed by white space (or a quote's or bracket's end and white space).
SENTENCE_END = r"""([.!?;:]["')]?)[ \t\n]+"""
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Every known sentence holds one of these (single words, which no line's end cuts), so other texts need no cutting.
ANCHORS = ["licen", "reserved", "redistribut", "copyright", "warrant", "unencumbered", "permission", "software", "domain", "mozilla"]


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order, as one string of ``<id>``.

    Lines of a paragraph are joined before it is cut into sentences, so wrapped texts match; a line that is a
    sentence by itself (a title or notice without a stop) counts too, after those of its paragraph. A paragraph
    gives each identifier once.
    """
    low = F.lower(text)
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    tidy = low
    for pattern, by in PREPARED:
        tidy = F.regexp_replace(tidy, pattern, by)
    id_of = lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, NOT_WORD, " ")))
    sentences = lambda p: F.split(F.regexp_replace(p, SENTENCE_END, "$1\f"), "\f")
    of = lambda p: F.array_distinct(F.filter(F.transform(F.concat(sentences(p), F.split(p, "\n")), id_of), lambda x: x.isNotNull()))
    found = F.flatten(F.transform(F.split(tidy, "\f"), of))
    ids = F.concat_ws("", F.transform(found, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | F.contains(low, F.lit(word))
    return F.when(anchored, ids).otherwise("")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences (known licence sentences), sentences (their identifiers in order),
    n_licenses and licenses (names in the order of the rules, each once, joined by commas).

    Null and empty texts have none of these (0 and ''). Repeated rows and null ids keep a row each; extra
    columns are ignored; an empty table gives an empty result. One pass, no shuffle, whole texts.
    """
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_sequence(q)).alias("seq"), F.lit("#" * len(q)).alias("used")) for n, q in RULES])
    start = F.struct(F.col("sentences").alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(s: Column, r: Column) -> Column:
        hit = F.contains(s["left"], r["seq"])
        return F.struct(
            F.when(hit, F.replace(s["left"], r["seq"], r["used"])).otherwise(s["left"]).alias("left"),
            F.when(hit, F.array_append(s["names"], r["name"])).otherwise(s["names"]).alias("names"),
        )

    names = F.when(F.col("sentences") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.aggregate(rules, start, apply, lambda s: s["names"]))
    )
    return (
        df.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("sentences"))
        .withColumn("names", names)
        .select(
            id_col,
            (F.length("sentences") - F.length(F.replace("sentences", F.lit("<")))).cast("long").alias("n_sentences"),
            "sentences",
            F.size("names").cast("long").alias("n_licenses"),
            F.array_join("names", ",").alias("licenses"),
        )
    )


def _literal(text: str) -> str:
    """A string of DuckDB SQL."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\f", "' || chr(12) || '") + "'"


def scan_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same in DuckDB SQL, without the anchor words."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    tidy = f"lower(coalesce({text_col}, ''))"
    for pattern, by in PREPARED:
        tidy = f"regexp_replace({tidy}, {_literal(pattern)}, {_literal(by.replace('$', chr(92)))}, 'g')"
    steps = [
        f"""known(sentence, sid) AS (VALUES {values}),
doc AS (SELECT {id_col}, string_split({tidy}, chr(12)) AS paras, row_number() OVER () AS rn FROM {table}),
para AS (SELECT rn, unnest(paras) AS p, generate_subscripts(paras, 1) AS k FROM doc),
cut AS (SELECT rn, k, list_concat(string_split(regexp_replace(p, {_literal(SENTENCE_END)}, '\\1' || chr(12), 'g'), chr(12)), string_split(p, chr(10))) AS parts FROM para),
lines AS (SELECT rn, k, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
first AS (SELECT rn, k, sid, min(pos) AS pos FROM lines JOIN known ON trim(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = sentence GROUP BY ALL),
hits AS (SELECT rn, string_agg('<' || sid || '>', '' ORDER BY k, pos) AS sentences FROM first GROUP BY rn),
s0 AS (SELECT {id_col}, coalesce(sentences, '') AS sentences, coalesce(sentences, '') AS rest, CAST([] AS VARCHAR[]) AS names FROM doc LEFT JOIN hits USING (rn))"""
    ]
    for k, (name, seq) in enumerate(RULES):
        q = _sequence(seq)
        steps.append(
            f"""s{k + 1} AS (SELECT {id_col}, sentences, replace(rest, '{q}', '{"#" * len(seq)}') AS rest,
  CASE WHEN contains(rest, '{q}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM s{k})"""
        )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT {id_col}, CAST(length(sentences) - length(replace(sentences, '<', '')) AS BIGINT) AS n_sentences, sentences,
  CAST(len(names) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses FROM s{len(RULES)}"""
    )
