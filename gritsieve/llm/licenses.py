"""License scans: conditional compression against templates, then exact differences in wording."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The invariant wording of common licenses and notices (years and holders are not part of it).
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "No license": "All rights reserved.",
}

#: Words that every template has one of.
HINT = r"(?i)licen[sc]|rights\s+reserved|permission\s+to|hereby\s+granted|redistribut|public\s+domain|creative\s+commons"

#: Production parameters: the wording differences allowed as a share of a template's words, rounded down; the words looked
#: at before and after a hint, which exceed the longest template; and the zstandard level.
DIFFERENCES = 0.1
REACH = 120
LEVEL = 19

_WORD = re.compile(r"\w+")
COLUMNS = (
    "license string, start long, end long, plain_bytes int, saved_bytes int, missing array<string>, extra array<string>"
)


class Templates:
    """The templates as words, and compressors that have them as raw dictionaries."""

    def __init__(self, texts: dict[str, str], level: int = LEVEL):
        self.words = {name: [w.lower() for w in _WORD.findall(text)] for name, text in texts.items()}
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_template = {}
        for name, words in self.words.items():
            content = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template[name] = zstandard.ZstdCompressor(
                level=level, dict_data=content, write_content_size=False, write_dict_id=False)

    def ranked(self, words: list[str]) -> tuple[int, list[tuple[int, str]]]:
        """The compressed size, and the templates by the bytes they save, most first; of equals the longer template.

        In a long block a short notice may save nothing, so all are ranked; the wording decides in that order."""
        data = " ".join(words).encode()
        size = len(self.plain.compress(data))
        saved = [(size - len(c.compress(data)), name) for name, c in self.with_template.items()]
        return size, sorted(saved, key=lambda x: (-x[0], -len(self.words[x[1]]), x[1]))

    def differences(self, name: str, words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """Where a template stands in the words, what is missing and what is extra; None if it differs too much."""
        template = self.words[name]
        allowed = int(DIFFERENCES * len(template))
        if (Counter(template) & Counter(words)).total() < len(template) - allowed:
            return None
        for begin, window in self._windows(template, words, allowed):
            steps = SequenceMatcher(None, template, window, autojunk=False).get_opcodes()
            while steps and steps[0][0] == "insert":
                steps.pop(0)
            while steps and steps[-1][0] == "insert":
                steps.pop()
            missing = [w for kind, a, b, _, _ in steps if kind in ("delete", "replace") for w in template[a:b]]
            extra = [w for kind, _, _, a, b in steps if kind in ("insert", "replace") for w in window[a:b]]
            if steps and max(len(missing), len(extra)) <= allowed:
                return begin + steps[0][3], begin + steps[-1][4], missing, extra
        return None

    @staticmethod
    def _windows(template: list[str], words: list[str], allowed: int) -> Iterator[tuple[int, list[str]]]:
        """Where the template can stand: its place by the longest common run first, then every other place.

        A copy with `allowed` words missing at most keeps a run of `size` template words unbroken, so each copy has such a
        run, and its offset (place in the words less place in the template) is off by `allowed` words at most. Windows that
        lack too many of the template's words are left out.
        """
        size = max(1, (len(template) - allowed) // (2 * allowed + 1))
        places: dict[tuple[str, ...], list[int]] = {}
        for i in range(len(template) - size + 1):
            places.setdefault(tuple(template[i : i + size]), []).append(i)
        offsets = Counter(j - i for j in range(len(words) - size + 1) for i in places.get(tuple(words[j : j + size]), ()))
        if not offsets:
            return
        best = SequenceMatcher(None, template, words, autojunk=False).find_longest_match()
        order = [best.b - best.a, *sorted(offsets.keys() - {best.b - best.a}, key=lambda x: (-offsets[x], x))]
        least, wanted = len(template) - allowed, Counter(template)
        for offset in order:
            begin = max(0, offset - allowed)
            window = words[begin : max(0, offset + len(template) + allowed)]
            if (wanted & Counter(window)).total() >= least:
                yield begin, window


def scan_text(text: str, templates: Templates) -> list[tuple]:
    """Findings of one text: license, start and end in code points, compressed bytes, bytes saved, words missing and extra.

    Blocks are the words around hints. The best template that is confirmed takes its words out of the block, and what
    is left on either side is a block again.
    """
    blocks: list[list[int]] = []
    for hint in re.finditer(HINT, text):
        # The words around a hint, found by stepping through text of bounded length.
        begin, end = hint.start(), hint.end()
        for _ in range(REACH):
            word = _WORD_BEFORE.search(text[max(0, begin - 200) : begin])
            if not word:
                break
            begin = max(0, begin - 200) + word.start()
        after = 0
        for word in _WORD.finditer(text, end):
            end, after = word.end(), after + 1
            if after == REACH:
                break
        if blocks and begin <= blocks[-1][1]:
            blocks[-1][1] = max(end, blocks[-1][1])
        else:
            blocks.append([begin, end])
    out = []
    for begin, end in blocks:
        tokens = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text, begin, end)]
        step = 4 * REACH  # a long block is looked at in overlapping windows, so that none grows without bound
        todo = [tokens[at : at + step + 2 * REACH] for at in range(0, max(1, len(tokens)), step)]
        while todo:
            block = todo.pop()
            words = [t[0] for t in block]
            size, ranking = templates.ranked(words) if words else (0, [])
            for saved, name in ranking:
                found = templates.differences(name, words)
                if found:
                    first, last, missing, extra = found
                    out.append((name, block[first][1], block[last - 1][2], size, saved, missing, extra))
                    todo += [block[:first], block[last:]]
                    break
    return _without_overlaps(out)


_WORD_BEFORE = re.compile(r"\w+\W*$")


def _without_overlaps(found: list[tuple]) -> list[tuple]:
    """Windows overlap, so a finding may come twice or cut short: the longer, then better saving one stays."""
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[1] - f[2], -f[4], f[0])):
        if all(f[2] <= g[1] or f[1] >= g[2] for g in out):
            out.append(f)
    return sorted(out, key=lambda f: f[1])


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None
) -> DataFrame:
    """One row per license text or notice found: doc_id and the columns of COLUMNS; documents without any have no row.

    Only texts with a hint leave the JVM. A null or empty text has no finding, repeated rows have equal findings, and a
    null id stays null. start and end are code points, end exclusive. An empty table gives an empty one.
    """
    given = TEMPLATES if texts is None else texts

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates, names = Templates(given), [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            found = [(i, *f) for i, t in zip(batch["doc_id"], batch["t"]) for f in scan_text(t, templates)]
            yield pd.DataFrame(found, columns=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    rows = docs.where(text.rlike(HINT)).select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    return rows.mapInPandas(scan, f"doc_id {kind}, {COLUMNS}")
