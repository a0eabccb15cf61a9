"""Licences named in whole texts, by rules over sequences of known sentences.

Texts are brought to a normal form (lower case, runs of anything but letters,
digits, ``.`` and ``+`` become a blank) in which sentence ends and breaks stay
marked: line breaks, and blanks after ``:`` or ``;``. A known sentence starts
and ends at a mark and may run across breaks, however narrow the lines, but not
across a sentence end; the dot of ``v.`` is none. One pass finds all of them,
the longest first where several start alike; what one sentence takes does not
start another. Their identifiers, in order of place, are then matched against
the rules, the first rule first; what a rule takes is gone for the later ones.
Sentences that no rule takes are counted.

All of it is column expressions on the row: no shuffle, no Python. The tables
of sentences and rules are part of the code. Defined results: a null or empty
text has no licence, an empty table gives no row; repeated rows get the same
answer; texts of any length are read in whole; columns of the documents pass
through, those that clash with the results are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks in a normal form: the end of a sentence, and a break a sentence may run across.
END, BREAK = "\x01", "\n"
#: Every known sentence has one of these words, so other texts are not cut up.
MENTION = r"(?i)licen[sc]|warrant|permission|redistribut|public\W+domain|cc\W+by|cc0|copyright"

#: Known sentences in normal form, by identifier.
SENTENCES = {
    "apache2.short": "licensed under the apache license version 2.0",
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.full": 'licensed under the apache license version 2.0 the license',
    "apache2.copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache2.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "mit.short": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd.short": "licensed under the bsd license",
    "bsd2.short": "licensed under the bsd 2 clause license",
    "bsd3.short": "licensed under the bsd 3 clause license",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.short": "licensed under the gnu general public license version 3",
    "gpl2.short": "licensed under the gnu general public license version 2",
    "gpl2.work": "this work is licensed under the gnu general public license version 2",
    "gpl3.later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.none": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "gpl.copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3.short": "licensed under the gnu lesser general public license version 3",
    "agpl3.short": "licensed under the gnu affero general public license version 3",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl2.short": "licensed under the mozilla public license version 2.0",
    "ccby.short": "licensed under cc by 4.0",
    "ccbysa.short": "licensed under cc by sa 4.0",
    "ccbync.short": "licensed under cc by nc 4.0",
    "ccbynd.short": "licensed under cc by nd 4.0",
    "ccby.long": "this work is licensed under a creative commons attribution 4.0 international license",
    "ccbysa.long": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "ccbync.long": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0.short": "licensed under cc0 1.0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "epl2.short": "licensed under the eclipse public license version 2.0",
}
#: Rules in order; each takes its sequence of sentences wherever it stands.
RULES = (
    ("Apache-2.0", ("apache2.full", "apache2.use", "apache2.copy", "apache2.asis", "apache2.see")),
    ("Apache-2.0", ("apache2.short", "apache2.use", "apache2.copy", "apache2.asis", "apache2.see")),
    ("Apache-2.0", ("apache2.full", "apache2.use", "apache2.copy")),
    ("Apache-2.0", ("apache2.short", "apache2.use", "apache2.copy")),
    ("Apache-2.0", ("apache2.full",)),
    ("Apache-2.0", ("apache2.short",)),
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.short",)),
    ("MIT", ("mit.licensed",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-3-Clause", ("bsd3.short",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-2-Clause", ("bsd2.short",)),
    ("BSD", ("bsd.short",)),
    ("GPL-3.0-or-later", ("gpl3.later", "gpl.none", "gpl.see", "gpl.copy")),
    ("GPL-3.0-or-later", ("gpl3.later", "gpl.none", "gpl.see")),
    ("GPL-3.0-or-later", ("gpl3.later",)),
    ("GPL-2.0-or-later", ("gpl2.later", "gpl.none", "gpl.see", "gpl.copy")),
    ("GPL-2.0-or-later", ("gpl2.later", "gpl.none", "gpl.see")),
    ("GPL-2.0-or-later", ("gpl2.later",)),
    ("GPL-3.0", ("gpl3.work",)),
    ("GPL-3.0", ("gpl3.short",)),
    ("GPL-2.0", ("gpl2.work",)),
    ("GPL-2.0", ("gpl2.short",)),
    ("LGPL-3.0", ("lgpl3.short",)),
    ("AGPL-3.0", ("agpl3.short",)),
    ("MPL-2.0", ("mpl2.form",)),
    ("MPL-2.0", ("mpl2.short",)),
    ("CC-BY-4.0", ("ccby.short",)),
    ("CC-BY-SA-4.0", ("ccbysa.short",)),
    ("CC-BY-NC-4.0", ("ccbync.short",)),
    ("CC-BY-ND-4.0", ("ccbynd.short",)),
    ("CC-BY-4.0", ("ccby.long",)),
    ("CC-BY-SA-4.0", ("ccbysa.long",)),
    ("CC-BY-NC-4.0", ("ccbync.long",)),
    ("CC0-1.0", ("cc0.short",)),
    ("ISC", ("isc.grant",)),
    ("Unlicense", ("unlicense.free",)),
    ("EPL-2.0", ("epl2.short",)),
)


def normal_form(text: Column) -> Column:
    """The text in lower case with blanks, ``END`` and ``BREAK`` between its words."""
    steps = (
        (END, " "),
        (r"(?<=[.!?])(?<!\bv\.)\s+", END),
        (r"(?<=[:;])[^\S\n]+", BREAK),
        (rf"[^a-z0-9.+{BREAK}{END}]+", " "),
        # a run is tried from its first character only, so long ones stay linear
        (rf"(?<![ .])[ .]*+{END}[ .{BREAK}{END}]*", END),
        (rf" ?{BREAK}[ .{BREAK}]*", BREAK),
        (rf"^[ .{BREAK}]+|(?<![ .{BREAK}])[ .{BREAK}]++$", ""),
    )
    out = F.lower(text)
    for pattern, mark in steps:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(mark))
    return out


def sentence_pattern() -> str:
    """Any known sentence between marks, the longest first."""
    known = "|".join(
        re.escape(s).replace(r"\ ", f"[ {BREAK}]") for s in sorted(SENTENCES.values(), key=len, reverse=True)
    )
    return rf"(?<![^{BREAK}{END}])(?:{known})(?![^{BREAK}{END}])"


def found_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order of place."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, name)])
    found = F.regexp_extract_all(normal_form(text), F.lit(sentence_pattern()), F.lit(0))
    names = F.transform(found, lambda s: known[F.translate(s, BREAK, " ")])
    return F.when(text.rlike(MENTION), names).otherwise(F.array().cast("array<string>"))


def apply_rules(ids: Column) -> Column:
    """(left, licences): what no rule took, and the licences of the rules that took something."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(seq) + "|").alias("seq")) for name, seq in RULES])
    start = F.struct(
        F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("licences")
    )

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["seq"], F.lit("||"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_append(acc["licences"], rule["name"])).otherwise(acc["licences"]).alias("licences"),
        )

    return F.aggregate(table, start, step)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentences`` (identifiers in order), ``licences`` (sorted) and ``n_left``."""
    ids = docs.withColumn("sentences", found_sentences(F.coalesce(F.col(text_col), F.lit(""))))
    none = F.array().cast("array<string>")
    some = F.size("sentences") > 0
    ruled = ids.withColumn("_ruled", F.when(some, apply_rules(F.col("sentences"))))
    left = F.filter(F.split(F.col("_ruled")["left"], r"\|"), lambda x: x != "")
    return ruled.withColumns(
        {
            "licences": F.when(some, F.array_sort(F.array_distinct(F.col("_ruled")["licences"]))).otherwise(none),
            "n_left": F.when(some, F.size(left)).otherwise(0).cast("bigint"),
        }
    ).drop("_ruled")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.array_join("sentences", ",").alias("sentences"),
        "n_left",
    )
