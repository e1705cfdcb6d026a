"""License scans: a positional index of rare tokens, verified by mandatory key phrases.

The index holds every word of every passage of the licences with its positions.  A passage stands at a place
of a file if, within SLACK words of where they belong, every mandatory phrase of it and LEAST of its other words are there.  So of the
words of a passage that a file has, only the rarest need be looked up: if all but ``need - VOTES`` positions are looked up,
VOTES of them at least are in their places wherever the passage stands, and none is lost.  The rarest are those
with the highest inverse document frequency, counted over all documents.  Each place of such a word votes for place - position
in the passage; places where the votes of VOTES positions meet are candidates, and mandatory phrases and LEAST verify
them.  A label's score is the greatest part of a passage of it that is in its place.

Fixed base phrases are found at every place besides.  Words are runs of ASCII digits,
letters and all other non-ASCII characters, A-Z in lower case.

Defined results: NULL and empty texts have no words and no labels, score 0; equal counts of
rare words are told apart by the word; of several places and passages of a label the best counts; a NULL key comes out as
NULL; repeated rows are scanned each; texts are scanned whole, however long; an empty table gives
no rows; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import texts

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label: (passage of a well-known notice or licence text, phrases it must have), ...
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
TEMPLATES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "agpl": (
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
        ("licensed under the gnu affero general public license", ("affero general public license",)),
    ),
    "apache-2.0": (
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license",)),
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("on an as is basis without warranties or conditions of any kind",)),
        ("licensed under the apache license version 2 0", ("apache license",)),
    ),
    "bsd": (
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("source and binary forms",)),
        ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
        ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors as is",)),
    ),
    "bsl-1.0": (("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),),
    "cc-by-4.0": (("cc by 4 0", ("cc by 4 0",)), ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",))),
    "cc-by-nc": (("cc by nc 4 0", ("cc by nc",)), ("licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",))),
    "cc-by-nd": (("cc by nd 4 0", ("cc by nd",)), ("licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives 4 0",))),
    "cc-by-sa": (("cc by sa 4 0", ("cc by sa",)), ("licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",))),
    "cc0": (("cc0 1 0 universal public domain dedication", ("cc0",)), ("released under cc0", ("cc0",)), ("licensed under cc0", ("cc0",))),
    "gpl-2.0": ((_GNU.format("general public license", "2"), ("either version 2 of the license",)), ("licensed under the gnu general public license version 2", ("gnu general public license version 2",))),
    "gpl-3.0": ((_GNU.format("general public license", "3"), ("either version 3 of the license",)), ("licensed under the gnu general public license version 3", ("gnu general public license version 3",))),
    "isc": (
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
        ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("the author disclaims all warranties with regard to this software",)),
    ),
    "lgpl": (
        ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
        ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    ),
    "mit": (
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
        ("licensed under the mit license", ("mit license",)),
        ("released under the mit license", ("mit license",)),
    ),
    "mpl-2.0": (("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),),
    "unlicense": (("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software",)),),
    "wtfpl": (("do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("what the fuck you want to public license",)),),
    "zlib": (("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable for any damages arising from the use of this software",)),),
}
#: Part of a passage's words, besides its phrases, that must be in their places.
LEAST = 0.5
#: Words by which a word or phrase may stand off its place.
SLACK = 3
#: So many looked-up positions of a passage must agree on a place (fewer if it needs fewer words).
VOTES = 3

_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass
class Passage:
    """rarest: positions, those of the rarest words first; phrases: (words, position); need: words that must be in their places."""

    label: str
    words: list[bytes]
    phrases: list[tuple[list[bytes], int]]
    need: int
    rarest: list[int]


@dataclass
class Index:
    """postings: word -> passage -> positions of the word there."""

    postings: dict[bytes, dict[int, list[int]]]
    passages: list[Passage]


def build_index(df: dict[str, int], n_docs: int, templates=None) -> Index:
    """df: documents that hold a word. Words no document has are the rarest."""
    postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    passages = []
    for label, notices in sorted((templates or TEMPLATES).items()):
        for notice, phrases in notices:
            words, places = notice.encode().split(), []
            for phrase in phrases:
                p = phrase.encode().split()
                places.append((p, next(i for i in range(len(words)) if words[i : i + len(p)] == p)))
            for i, w in enumerate(words):
                postings[w][len(passages)].append(i)
            said = len({at + i for p, at in places for i in range(len(p))})
            passages.append(Passage(label, words, places, said + math.ceil(LEAST * (len(words) - said)), []))
    idf = {w: math.log((1 + n_docs) / (1 + df.get(w.decode(), 0))) for w in postings}
    rank = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-round(idf[w], 9), w)))}
    for p in passages:
        p.rarest = sorted(range(len(p.words)), key=lambda i: (rank[p.words[i]], i))
    return Index({w: dict(found) for w, found in postings.items()}, passages)


def base_hits(padded: bytes) -> tuple[int, int | None, int | None, list[str]]:
    """Places of the base phrases in words joined and surrounded by single spaces: how many, first and last word, labels."""
    n, first, last, labels = 0, None, None, []
    for phrase, label in BASE.items():
        needle = b" %b " % phrase.encode()
        at = padded.find(needle)
        if at < 0:
            continue
        labels.append(label)
        start, end = padded.count(b" ", 0, at), padded.count(b" ", 0, padded.rfind(needle))
        first, last = min(start, first if first is not None else start), max(end, last if last is not None else end)
        while at >= 0:
            n, at = n + 1, padded.find(needle, at + 1)
    return n, first, last, sorted(labels)


def looked_up(present: set[bytes], index: Index) -> dict[bytes, list[tuple[int, int]]]:
    """The file's rarest words of each passage that it has enough words for: word -> (passage, position)."""
    had: Counter[int] = Counter()
    for word in present:
        for i, places in index.postings[word].items():
            had[i] += len(places)
    wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for i, n in had.items():
        p = index.passages[i]
        if n >= p.need:
            standing = [at for at in p.rarest if p.words[at] in present]
            for at in standing[: n - p.need + min(VOTES, p.need)]:
                wanted[p.words[at]].append((i, at))
    return wanted


def in_place(words: list[bytes], shift: int, passage: Passage) -> int:
    """Words of the passage that stand within SLACK of their places, if it begins at ``shift``; 0 without its phrases."""
    for p, at in passage.phrases:
        if not any(words[i : i + len(p)] == p for i in range(max(0, shift + at - SLACK), shift + at + SLACK + 1)):
            return 0
    return sum(w in words[max(0, shift + i - SLACK) : max(0, shift + i + SLACK + 1)] for i, w in enumerate(passage.words))


def rare_hits(words: list[bytes], index: Index) -> dict[str, float]:
    """label -> greatest part of a passage whose words stand in their places."""
    wanted = looked_up(index.postings.keys() & set(words), index)
    if not wanted:
        return {}
    # for each passage and beginning the positions that agree on it, as bits
    votes: dict[tuple[int, int], int] = defaultdict(int)
    for place, word in enumerate(words):
        for i, at in wanted.get(word, ()):
            for shift in range(place - at - SLACK, place - at + SLACK + 1):
                votes[i, shift] |= 1 << at
    found: dict[str, float] = {}
    for (i, shift), agreeing in votes.items():
        p = index.passages[i]
        if agreeing.bit_count() >= min(VOTES, p.need):
            n = in_place(words, shift, p)
            if n >= p.need:
                found[p.label] = max(found.get(p.label, 0.0), n / len(p.words))
    return found


def scan_text(text: str | None, index: Index) -> tuple:
    words = words_of(text or "")
    n, first, last, base = base_hits(b" %b " % b" ".join(words)) if words else (0, None, None, [])
    found = rare_hits(words, index)
    score = max([0.0, *found.values(), *([0.5] if base else [])])
    return len(words), n, first, last, ",".join(base), ",".join(sorted({*base, *found})), score


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def word_counts(rows: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary stands, over all documents; and how many there are."""
    wanted = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(wanted.intersection(words_of(text)))
                n += 1
        names = [*(w.decode() for w in seen), ""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    # a row for each word of the vocabulary, however large the corpus
    got = {r.word: r.n for r in rows.select("t").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: n for w, n in got.items() if w}, got.get("", 0)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=None) -> DataFrame:
    """A row for each row of ``df``."""
    rows = texts(df, key, text)
    vocabulary = {w for notices in (templates or TEMPLATES).values() for notice, _ in notices for w in notice.split()}
    index = build_index(*word_counts(rows, vocabulary), templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan_text(t, index) for t in batch.column(1).to_pylist()]
            columns = list(zip(*got, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return rows.mapInArrow(scan, DDL).withColumnRenamed("doc_id", key)
