"""License scan by patience alignment.

A template and a text are aligned on words that occur exactly once in either; of these anchors the
longest run that ascends in both is kept, and the gaps between them are aligned the same way, down
to gaps without anchors. The share of the template's words that are matched is its coverage.

Texts are aligned in overlapping blocks of three times the template's length, so a notice up to twice
as long as its template lies whole in one. Where a block holds a notice more than once, its words are
not unique; there the block is cut to the template's length around every occurrence of one of the
template's words, of one word after the other until a cut reaches the coverage. Matches far from the
others at either end are dropped. Blocks that hold too few of the template's words to reach the wanted coverage are
left out beforehand, which loses nothing.

A license is only reported if the words that name it are matched and no word that names another one
stands within the notice, or soon after it where the other license only adds to its text.

Words are compared in lower case without punctuation around them, versions without ``v`` before and
``.0`` behind them. Per template the block with most
matches counts (ties: the first); per document the template with the greatest coverage, then most
words, then first by name.

Edges: a null or empty text has no license. Repeated rows are documents of their own. Other columns
of the input are ignored.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from metertide.llm.batches import Words, slices, words_of

# Notices as their licenses word them.
_GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
    "Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": "This program is free software: "
    + _GNU.format("Affero General Public License", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": (
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; "
    + _GNU.format("General Public License", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: "
    + _GNU.format("General Public License", "3"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": "This library is free software; "
    + _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": "This library is free software: "
    + _GNU.format("Lesser General Public License", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means."
    ),
}


@dataclass(frozen=True)
class Naming:
    """Words of a template that must be matched, and words that must not stand between the first and
    the last word matched or among the ``after`` words that follow."""

    words: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    after: int = 0


_OTHER_GNU = ("lesser", "affero", "library")
NAMING = {
    "AGPL-3.0": Naming(("affero", "general", "public", "3")),
    "Apache-2.0": Naming(("apache", "2")),
    "BSD": Naming(("bsd",)),
    "BSD-2-Clause": Naming(("source", "binary"), ("endorse", "advertising"), 60),
    "BSD-3-Clause": Naming(("neither", "endorse"), ("advertising",)),
    "BSL-1.0": Naming(("boost", "1")),
    "CC-BY-4.0": Naming(("cc", "by", "4")),
    "CC-BY-NC-4.0": Naming(("cc", "by-nc", "4")),
    "CC-BY-NC-ND-4.0": Naming(("cc", "by-nc-nd", "4")),
    "CC-BY-NC-SA-4.0": Naming(("cc", "by-nc-sa", "4")),
    "CC-BY-ND-4.0": Naming(("cc", "by-nd", "4")),
    "CC-BY-SA-4.0": Naming(("cc", "by-sa", "4")),
    "CC0-1.0": Naming(("cc0", "1")),
    "EPL-2.0": Naming(("eclipse", "2")),
    "GPL-2.0": Naming(("general", "public", "2"), _OTHER_GNU),
    "GPL-3.0": Naming(("general", "public", "3"), _OTHER_GNU),
    "ISC": Naming((), ("documentation",)),
    "LGPL-2.1": Naming(("lesser", "general", "public", "2.1")),
    "LGPL-3.0": Naming(("lesser", "general", "public", "3")),
    "MIT": Naming(("mit",)),
    "MIT-notice": Naming((), ("redistributions", "evil"), 15),
    "MPL-2.0": Naming(("mozilla", "2")),
    "Unlicense": Naming(("unencumbered", "domain")),
}
NAMING |= {f"{n}-notice": x for n, x in NAMING.items() if n != "MIT" and f"{n}-notice" in TEMPLATES}
COVERAGE = 0.8
#: Matched words among all words from the first to the last one matched, at least.
DENSITY = 0.5
#: A block's words, by the template's.
BLOCK = 3


def normal(words: pa.Array) -> pa.Array:
    """Lower case, without what is neither letter nor digit around a word; versions by their number."""
    bare = pc.replace_substring_regex(
        pc.utf8_lower(words), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""
    )
    return pc.replace_substring_regex(bare, r"^v?(\d+)(\.0)?$", r"\1")


def longest_ascending(values: list[int]) -> list[int]:
    """Places of the longest strictly ascending subsequence, by patience sorting."""
    tops, places, before = [], [], [-1] * len(values)
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            places.append(place)
        else:
            tops[pile], places[pile] = value, place
        before[place] = places[pile - 1] if pile else -1
    result, place = [], places[-1] if places else -1
    while place >= 0:
        result.append(place)
        place = before[place]
    return result[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two word lists, ascending in both."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        chain = [pairs[p] for p in longest_ascending([j for _, j in pairs])]
        if not chain:
            continue
        matched += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            # Before the first and after the last anchor only the text next to it is of interest.
            near = 2 * (k - i)
            low, high = j + 1, m
            if (i, j) == edges[0]:
                low = max(low, m - near)
            if (k, m) == edges[-1]:
                high = min(high, j + 1 + near)
            todo.append((i + 1, k, low, high))
    return sorted(matched)


def _blocks(words: Words, member: np.ndarray, length: int, least: int):
    """Text, begin and end (places among all words) of blocks with ``least`` words of the template."""
    total = np.concatenate(([0], np.cumsum(member[words.index])))
    per_text = np.maximum(1, -(-words.counts // length) - (BLOCK - 1))
    per_text[words.counts == 0] = 0
    text = np.repeat(np.arange(len(per_text)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = words.starts[text] + nth * length
    end = np.minimum(begin + BLOCK * length, words.starts[text + 1])
    enough = np.flatnonzero(total[end] - total[begin] >= least)
    return zip(text[enough].tolist(), begin[enough].tolist(), end[enough].tolist(), strict=True)


def trimmed(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of matches that are dense enough, the first of several."""
    places = [j for _, j in pairs]
    for size in range(len(pairs), 0, -1):
        for begin in range(len(pairs) - size + 1):
            if size >= DENSITY * (places[begin + size - 1] - places[begin] + 1):
                return pairs[begin : begin + size]
    return pairs


def align_within(
    template: list[str], block: list[str], fits: Callable[[list], bool], naming: tuple[str, ...] = ()
) -> list[tuple[int, int]]:
    """Matched places of the template in a block, of one copy if there are several; empty if no
    alignment ``fits``."""
    best = trimmed(align(template, block))
    if fits(best):
        return best
    times = Counter(template)
    middle = len(template) / 2
    inside = set(block)
    keys = [i for i, w in enumerate(template) if times[w] == 1 and w in inside]
    best = []
    # A word that names the license is rarer than others and is needed anyway.
    for key in sorted(keys, key=lambda i: (template[i] not in naming, abs(i - middle), i)):
        for place in [p for p, w in enumerate(block) if w == template[key]]:
            begin = max(0, place - key)
            cut = trimmed(align(template, block[begin : place - key + len(template)]))
            pairs = [(i, j + begin) for i, j in cut]
            if len(pairs) > len(best) and fits(pairs):
                best = pairs
        if best:
            break
    return best


def inside_all(wanted: tuple[str, ...], block: list[str]) -> bool:
    return all(w in block for w in wanted)


def scan_words(words: Words, templates: dict[str, list[str]], coverage: float) -> dict[int, list]:
    """Per text with a match: (name, coverage, matched words, first word, last word), best first."""
    names = normal(words.distinct).to_pylist()
    found: dict[int, dict] = {}
    for name, template in sorted(templates.items()):
        known = set(template)
        member = np.fromiter((w in known for w in names), dtype=bool, count=len(names))
        if not member.any():
            continue
        least = max(1, int(np.ceil(coverage * len(template) - 1e-9)))
        rule, wanted = NAMING.get(name, Naming()), Counter(template)
        needed = [{i for i, w in enumerate(template) if w == word} for word in rule.words]
        for text, begin, end in _blocks(words, member, len(template), least):
            block = [names[i] for i in words.index[begin:end]]
            # No alignment matches a word more often than either side has it.
            if (wanted & Counter(block)).total() < least or not inside_all(rule.words, block):
                continue
            stop = int(words.starts[text + 1])

            def fits(pairs, begin=begin, stop=stop, least=least, rule=rule, needed=needed):
                if len(pairs) < least:
                    return False
                first, last = pairs[0][1], pairs[-1][1]
                matched = {i for i, _ in pairs}
                if len(pairs) < DENSITY * (last - first + 1) or not all(x & matched for x in needed):
                    return False
                reach = words.index[begin + first : min(stop, begin + last + 1 + rule.after)]
                return not rule.without or not any(names[i] in rule.without for i in reach)

            pairs = align_within(template, block, fits, rule.words)
            if not pairs:
                continue
            first, last = pairs[0][1], pairs[-1][1]
            best = found.setdefault(text, {}).get(name)
            if best is None or len(pairs) > best[2]:
                shift = begin - int(words.starts[text])
                found[text][name] = (
                    name, len(pairs) / len(template), len(pairs), first + shift, last + shift
                )
    return {
        text: sorted(by_name.values(), key=lambda x: (-x[1], -x[2], x[0]))
        for text, by_name in found.items()
    }


FIELDS = "license:string,coverage:double,matched:int,first_word:int,last_word:int"


def scan_licenses(
    documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """Per document its ``license`` (null: none), ``coverage`` (0 without one), ``matched`` words,
    the places of the first and last of them, and ``found``: the same of every template matched."""
    lists = {
        name: [w for w in normal(words_of(pa.array([text])).distinct.take(pa.array(
            words_of(pa.array([text])).index))).to_pylist() if w]
        for name, text in templates.items()
    }
    item = pa.struct(
        [("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
         ("first_word", pa.int32()), ("last_word", pa.int32())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = scan_words(words_of(part.column("text")), lists, coverage)
            rows = [found.get(i, []) for i in range(len(part))]
            best = [row[0] if row else (None, 0.0, 0, None, None) for row in rows]
            columns = [
                pa.array([b[k] for b in best], item.field(k).type) for k in range(item.num_fields)
            ]
            names = [item.field(k).name for k in range(item.num_fields)]
            every = [[dict(zip(names, x, strict=True)) for x in row] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns, pa.array(every, pa.list_(item))],
                ["doc_id", *names, "found"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, license string, coverage double, matched int, first_word int, "
        f"last_word int, found array<struct<{FIELDS}>>",
    )
