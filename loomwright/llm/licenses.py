"""Licence notices by conditional compression against templates."""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import slices

#: Public licences by SPDX name, with the names that notices call them by.
NAMES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "MIT": ["MIT License", "MIT license terms"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
#: How a notice announces a name, and the identifiers after the SPDX name.
FORMS = ["Licensed under {}.", "Licensed under the {}.", "Licensed under a {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}."]
#: How the identifier is given in fields of packages and in a sentence, and the titles of licence files.
FIELDS = ["License: {}", "This project is {} licensed."]
TITLES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["ISC License Copyright (c)"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["MIT License Copyright (c)", "The MIT License (MIT) Copyright (c)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
SPDX = ["", "-only", "-or-later"]
#: Public wordings of notices, by SPDX name.
TEXTS: dict[str, list[str]] = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
TEMPLATES: dict[str, list[str]] = {
    name: [form.format(n) for n in NAMES[name] for form in FORMS] + [f"SPDX-License-Identifier: {name}{end}" for end in (SPDX if "GPL" in name else SPDX[:1])] + [form.format(name) for form in FIELDS] + TITLES.get(name, []) + TEXTS.get(name, []) for name in sorted(NAMES)
}
#: Words that notices hold; between two of them the line may end and a comment mark may stand.
CUE = r"(?i)licen[sc]e|copyright|permission is hereby|permission is granted|permission to use|redistribution|public domain|released under|distributed under|waived all|creative commons|free software|SPDX".replace(" ", r"[\s*#/;>|!%-]+")
CUES = re.compile(CUE[4:], re.I)
#: A word; one with a hyphen may be wrapped behind it, and the next line may begin as a comment does.
WORDS = re.compile(r"\w+(?:[.-]\w+|-[ \t]*\r?\n[ \t*#/;>|!%-]*\w+)*")
BREAK = re.compile(r"-[ \t]*\r?\n[ \t*#/;>|!%-]*")
#: Words that carry the terms: if one is missing or stands where the template has none, it is another licence.
TERMS = frozenset("not no non nc nd sa by gnu gpl lgpl affero lesser general mit apache bsd mozilla creative cc cc0 isc boost eclipse zlib artistic noncommercial sharealike noderivatives attribution neither 1 2 3 1.0 1.1 2.0 2.1 3.0 4.0 v2.0 v2.1 v3.0".split()) | {"attribution-noncommercial", "attribution-sharealike", "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd", "3-clause", "2-clause", "gplv2", "gplv3", "lgplv2.1", "lgplv3", "agplv3", "unlicense"}


def words(s: str) -> list[str]:
    return [BREAK.sub("-", w).lower() for w in WORDS.findall(s)]


#: An SPDX line with several operands, and what stands in it: operands, and exceptions behind WITH.
EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[ \t]*[A-Za-z0-9.+-]+(?:[ \t]*\)*[ \t]+(?:AND|OR|WITH)[ \t]+\(*[ \t]*[A-Za-z0-9.+-]+)*[ \t]*\)*)", re.I)
OPERAND = re.compile(r"\bWITH[ \t]+[A-Za-z0-9.+-]+|\b(?:AND|OR)\b|([A-Za-z0-9][A-Za-z0-9.-]*\+?)", re.I)
LATER = re.compile(r"or-later|any later version", re.I)


class Template:
    """A wording with its words and a compressor that has it as raw dictionary, prepared once for a worker."""

    def __init__(self, name: str, text: str):
        import zstandard as z

        self.name, self.text, self.words = name, text, words(text)
        self.counts, self.terms, self.later = Counter(self.words), TERMS & set(self.words), bool(LATER.search(text))
        data = z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        self.packer = z.ZstdCompressor(level=19, dict_data=data, write_content_size=False, write_checksum=False)


class Templates:
    def __init__(self, by_name: dict[str, list[str]]):
        import zstandard as z

        self.all = [Template(n, t) for n, ts in by_name.items() for t in ts]
        self.plain = z.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)


@lru_cache(maxsize=4)
def prepared(held: tuple[tuple[str, tuple[str, ...]], ...]) -> Templates:
    return Templates({n: list(ts) for n, ts in held})


def tight(runs: list) -> list:
    """Matching runs without those at the edges that lie further from the rest, in the block, than their own words and the template's between are worth."""
    runs = [r for r in runs if r.size]
    for _ in range(len(runs)):
        if len(runs) < 2:
            break
        spare = lambda x, y, edge: (y.b - x.b - x.size) - (y.a - x.a - x.size) - edge.size
        first, last = spare(runs[0], runs[1], runs[0]), spare(runs[-2], runs[-1], runs[-1])
        if max(first, last) <= 0:
            break
        runs = runs[1:] if first >= last else runs[:-1]
    return runs


def differences(a: list[str], b: list[str], share: float) -> tuple[int, int, list[str], list[str]] | None:
    """Where the block's words b hold the template's a: first and last word's place, the words missing and those in excess; None
    if too few match, too many stand between, or one that differs carries terms."""
    runs = tight(difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    if not runs:
        return None
    same, met = {i for r in runs for i in range(r.a, r.a + r.size)}, {i for r in runs for i in range(r.b, r.b + r.size)}
    missing = [w for i, w in enumerate(a) if i not in same]
    first, last = runs[0].b, runs[-1].b + runs[-1].size - 1
    extra = [b[i] for i in range(first, last + 1) if i not in met]
    if len(same) < share * len(a) or TERMS & {*missing, *extra} or len(extra) > 0.3 * len(same):
        return None
    return first, last, missing, extra


def reach(n: int) -> int:
    """Words to either side of a cue that a notice of n template words can have: a cue may be any of its words, and 0.3 may stand between."""
    return n * 13 // 10 + 2


def operands(m: re.Match) -> list[tuple[str, int, int]]:
    """The licences that an SPDX expression names, with their places; exceptions are none."""
    return [(x[1], x.start(1), x.end(1)) for x in OPERAND.finditer(m.string, m.start(1), m.end(1)) if x[1]]


def ranked_best(held: Templates, block: str, share: float) -> dict | None:
    """What a block that is one notice and no more says: of the templates whose every word it holds the one that saves most bytes."""
    data, have = block.encode("utf-8", "replace"), words(block)
    ranked = sorted(((len(held.plain.compress(data)) - len(t.packer.compress(data)), -i) for i, t in enumerate(held.all) if t.terms <= set(have) and len(t.words) == len(have)), reverse=True)
    for saved, i in ranked:
        if saved > 0 and (got := differences(held.all[-i].words, have, share)) and not got[2] and not got[3]:
            return {"license": held.all[-i].name, "saved": int(saved), "missing": "", "extra": "", "or_later": held.all[-i].later}
    return None


def notices(text: str, templates: dict[str, list[str]] | None = None, share: float = 0.85) -> list[dict]:
    """Confirmed notices of one text: licence, start, end (code points), bytes saved and the words that differ.

    For each cue and template the candidate block is the words around the cue, across line feeds and comment marks, as far as
    the template is long. Templates are ranked by how many bytes of the packed block they save, most first, and the first is
    confirmed that matches at least the share of its words with no difference in a word of TERMS; all that save any are tried.
    Of those that save nearly as much (0.8) the one with the fewest differing words is reported.
    Blocks with fewer of a template's words than the share, or without one of its terms, cannot be confirmed and are not
    packed. The next cue is sought behind the notice, so each notice is reported once. An SPDX line with several operands gives a
    notice for each of them that has a template, found in the same way from a line with that operand alone. or_later says
    whether the wording allows later versions.
    """
    held = prepared(tuple((n, tuple(ts)) for n, ts in (templates or TEMPLATES).items()))
    tags = {m.start(): operands(m) for m in EXPRESSION.finditer(text)} if "SPDX" in text or "spdx" in text else {}
    cues = [m.start() for m in CUES.finditer(text)]
    spots = [(BREAK.sub("-", m[0]).lower(), m.start(), m.end()) for m in WORDS.finditer(text)] if cues else []
    ends, out, done = [e for _, _, e in spots], [], 0
    for here in cues:
        if here < done:
            continue
        if len(tags.get(here, ())) > 1 or here in tags and tags[here][0][0].endswith("+"):
            for name, start, end in tags[here]:
                if found := ranked_best(held, f"SPDX-License-Identifier: {re.sub('[+]$', '-or-later', name)}", share):
                    out.append(found | {"start": here if not out or out[-1]["start"] < here else start, "end": end})
                done = end
            continue
        k, free, ranked = bisect.bisect_right(ends, here), bisect.bisect_left(ends, done), []
        around: dict[int, tuple] = {}
        for i, t in enumerate(held.all):
            m = reach(len(t.words))
            if m not in around:
                part = spots[max(free, k - m) : k + m]
                around[m] = part, Counter(w for w, _, _ in part)
            part, have = around[m]
            if part and t.terms <= have.keys() and sum(min(n, have[w]) for w, n in t.counts.items()) >= share * len(t.words):
                data = text[part[0][1] : part[-1][2]].encode("utf-8", "replace")
                ranked.append((len(held.plain.compress(data)) - len(t.packer.compress(data)), -i, part))
        best: tuple | None = None
        for saved, i, part in sorted(ranked, key=lambda x: x[:2], reverse=True):
            if saved <= 0 or best and saved < 0.8 * best[1]:
                break
            got = differences(held.all[-i].words, [w for w, _, _ in part], share)
            if got and part[got[1]][2] > here >= done and part[got[0]][1] >= done:
                off = len(got[2]) + len(got[3])
                if best is None or off < best[0]:
                    best = off, best[1] if best else saved, {"license": held.all[-i].name, "start": part[got[0]][1], "end": part[got[1]][2], "saved": int(saved), "missing": " ".join(got[2]), "extra": " ".join(got[3]), "or_later": held.all[-i].later}
        if best:
            out.append(best[2])
            done = best[2]["end"]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per confirmed notice: id, license, start, end (code points, end exclusive), saved, missing, extra, or_later.

    Only texts with a cue leave the JVM; a null or empty text has none, an empty table gives none. A null id stays null and
    repeated rows repeat. Columns other than id and text are not read.
    """
    fields = [("license", "string"), ("start", "int"), ("end", "int"), ("saved", "int"), ("missing", "string"), ("extra", "string"), ("or_later", "boolean")]

    def each(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = [(i, n) for i, t in enumerate(b.column(1).to_pylist()) for n in notices(t, templates)]
            cols = [pa.array([n[f] for _, n in rows], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for f, t in fields]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int32())), *cols], names=[id_col, *[f for f, _ in fields]])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(f, {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}[t]) for f, t in fields]])
    return docs.select(id_col, F.col(text_col).alias("_lw_text")).where(F.col("_lw_text").rlike(CUE)).mapInArrow(each, schema)
