from __future__ import annotations

import random
import re
import textwrap

from galley.llm import license_scan as L


def normal(s):
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.+]+", " ", s.lower()))


KNOWN = {s: name for name, s in L.SENTENCES.items()}


def by_hand(text):
    """Sentences, cut into parts at breaks; from each part the longest known run of parts, then on behind it."""
    ids = []
    for sentence in re.split(r"(?<=[.!?])(?<!\bv\.)\s+", (text or "").lower()):
        parts = [p for p in re.split(r"\n|(?<=[:;])[^\S\n]+", sentence) if re.search(r"[a-z0-9+]", p)]
        i = 0
        while i < len(parts):
            for k in range(min(80, len(parts) - i), 0, -1):
                if (found := KNOWN.get(normal("\n".join(parts[i : i + k])))) is not None:
                    ids.append(found)
                    i += k - 1
                    break
            i += 1
    left, licences = list(ids), []
    for name, seq in L.RULES:
        k = 0
        hit = False
        while k + len(seq) <= len(left):
            if tuple(left[k : k + len(seq)]) == seq:
                left[k : k + len(seq)] = [None]
                hit = True
            k += 1
        if hit:
            licences.append(name)
    return ids, sorted(set(licences)), sum(x is not None for x in left)


def texts():
    rnd = random.Random(2)
    sentences = list(L.SENTENCES.values())
    wrap = lambda s: " ".join(s.split(" ")[: len(s.split(" ")) // 2]) + "\n * " + " ".join(s.split(" ")[len(s.split(" ")) // 2 :])
    out = [None, "", "nothing here. at all", "license " * 60_000, "Licensed under the Apache License, Version 2.0.", "(Licensed under CC BY-NC 4.0)"]
    out += ["word " * rnd.randint(0, 5) + ".\n" + rnd.choice([s.capitalize(), s.upper(), wrap(s)]) + rnd.choice([".", "!", "\nfoo bar.", ""]) for s in sentences]
    for _ in range(60):
        name, seq = rnd.choice(L.RULES)
        some = [L.SENTENCES[i] for i in seq] + rnd.sample(sentences, rnd.randint(0, 3))
        out.append(". ".join(some) + "." if rnd.random() < 0.5 else ".\n\n".join(map(wrap, some)))
    return out


def test_scan_equals_brute_force(spark):
    rows = [*enumerate(texts()), (4, texts()[4]), (None, texts()[5])]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id bigint, text string, licences string, n_left int").repartition(3)
    got = L.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.sentences, r.licences, r.n_left) == by_hand(r.text), r.text


HEADERS = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.""",
}


def test_published_headers_at_every_width(spark):
    rows = []
    for name, header in HEADERS.items():
        for width in (20, *range(50, 101)):
            for mark in ("", "# ", "// ", " * "):
                lines = [x for paragraph in header.split("\n\n") for x in [*textwrap.wrap(paragraph, width), ""]]
                rows.append((f"{name}|{width}|{mark}", "\n".join(mark + x for x in lines)))
    got = L.scan(spark.createDataFrame(rows, "name string, text string").repartition(8)).collect()
    wrong = [(r.name, r.licences, r.sentences) for r in got if r.licences != [r.name.split("|")[0]]]
    assert len(got) == len(rows) and not wrong, wrong[:3]


def test_tables_are_consistent(spark):
    assert all(s == normal(s) and re.search(L.MENTION, s) for s in L.SENTENCES.values())
    assert len(KNOWN) == len(L.SENTENCES)
    assert all(i in L.SENTENCES for _, seq in L.RULES for i in seq)
    assert {i for _, seq in L.RULES for i in seq} | {"gpl.none", "gpl.see", "gpl.copy"} >= set(L.SENTENCES) - {"apache2.use"}


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_text_stays_linear(spark):
    import time

    text = "word here.\n" * 20_000 + "Released under the MIT License.\n" + "line\n" * 20_000
    start = time.time()
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert time.time() - start < 30 and got.licences == ["MIT"]
    for run in (".", " ", ". ", "\n", ": ", "license v.\n", "-"):
        text = "Released under the MIT License\n" + run * 300_000 + "x"
        start = time.time()
        assert L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().licences == ["MIT"], run
        assert time.time() - start < 30, run
