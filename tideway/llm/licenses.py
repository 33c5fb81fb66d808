"""License scan: base phrases, and an exact set-similarity join of text blocks with license notices.

A block is a window of 2c words that begins at a multiple of c; a notice of n words meets the blocks of the least power of
two c that is at least n (8 at least), so what one notice finds doesn't depend on any other.  Words of notices are ordered
by how often they stand in all texts, rarest first.  A block holds a notice if it has 80 % of its distinct words: then one
of the rarest ``m - least + 1`` words of the notice's m stands in it (prefix filter), it has ``least`` words of notices
(length filter), and enough words of both follow the first common one (positional filter).  What passes is counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of well-known licenses (label, words that a block must have in any case, notice).
NOTICES = (
    ("agpl", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("all-rights-reserved", "reserved reproduced", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher."),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsl", "organization", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by", "cc by", "Licensed under CC BY 4.0."),
    ("cc-by", "creative commons attribution", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl", "gnu general", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "liable", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

#: The least share, in per cent, of a notice's distinct words that a block must have.
SHARE = 80
#: Bytes that the notices of one scan may have; their index goes to every task.
MOST_BYTES = 4 << 20
LEAST_WIDTH = 8
PIECE = 1 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a piece of it at a time; a piece ends between words."""
    data, at = text or b"", 0
    while at < len(data):
        part = data[at : at + PIECE].translate(_WORDS)
        if at + PIECE < len(data):
            cut = part.rfind(b" ")
            if cut < 0:  # one word longer than a piece: on to its end
                end = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(data, at + PIECE)
                part = data[at : end.start() if end else len(data)].translate(_WORDS)
                cut = len(part)
            part = part[:cut]
        yield part.split()
        at += max(1, len(part))


def words_of(text: str) -> list[bytes]:
    return [w for part in tokens(text.encode()) for w in part]


@dataclass(frozen=True)
class Notice:
    label: str
    needs: tuple[bytes, ...]
    words: tuple[bytes, ...]  # distinct
    least: int
    width: int


def notices(rows=NOTICES, share: int = SHARE) -> list[Notice]:
    """Notices as sets of words; ValueError beyond MOST_BYTES, or where a notice has no word."""
    if sum(len(x.encode()) for _, _, x in rows) > MOST_BYTES:
        raise ValueError(f"the notices have more than {MOST_BYTES} bytes; scan with parts of them")
    out = []
    for label, needs, text in rows:
        words = words_of(text)
        if not words:
            raise ValueError(f"the notice of {label} has no word")
        n = len(set(words))
        out.append(Notice(label, tuple(words_of(needs)), tuple(dict.fromkeys(words)), -(-share * n // 100), max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())))
    return out


class _Ranks(dict):
    """Numbers of the words that notices or phrases have; -1 for any other."""

    def __missing__(self, _):
        return -1


def numbered(texts: list, ranks: _Ranks) -> Iterator[np.ndarray]:
    for text in texts:
        parts = [np.fromiter(map(ranks.__getitem__, part), np.int32, len(part)) for part in tokens(text)]
        yield np.concatenate(parts) if parts else np.empty(0, np.int32)


def frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of the words, those of the notices, stands in all texts: one scan, one row for each word and task."""
    ranks = _Ranks({w: i for i, w in enumerate(words)})

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for x in numbered(b.column("text").to_pylist(), ranks):
                total += np.bincount(x[x >= 0], minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["word", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r.word]: r.n for r in found.collect()}  # no more rows than the notices have words


class Index:
    """The prefixes of all notices, their words numbered from the rarest."""

    def __init__(self, found: list[Notice], count: dict[bytes, int]):
        words = sorted({w for x in found for w in (*x.words, *x.needs)}, key=lambda w: (count.get(w, 0), w))
        self.ranks = _Ranks({w: i for i, w in enumerate(words)})
        self.rare = len(words)
        self.notices, self.sets, self.needs = found, [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(found):
            own = np.sort(np.array([self.ranks[w] for w in x.words], np.int32))
            self.sets.append(own)
            self.needs.append(np.array([self.ranks[w] for w in x.needs], np.int32))
            for i, r in enumerate(own[: len(own) - x.least + 1]):
                self.prefix.setdefault(int(r), []).append((k, i))
        self.first = np.zeros(len(words) + 1, bool)
        self.first[list(self.prefix)] = True  # the last place is that of all other words
        self.phrases = [(np.array([self.ranks.setdefault(w, len(self.ranks)) for w in words_of(p)], np.int32), label) for p, label in PHRASES.items()]

    def base(self, x: np.ndarray) -> list[tuple[int, str]]:
        """Place and label of each phrase."""
        out = []
        for phrase, label in self.phrases:
            hit = x[: max(0, len(x) - len(phrase) + 1)] == phrase[0]
            for i, r in enumerate(phrase[1:], 1):
                hit &= x[i : len(x) - len(phrase) + 1 + i] == r
            out += [(int(p), label) for p in np.flatnonzero(hit)]
        return out

    def blocks(self, x: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(notice, start, words, containment) of the blocks that hold a notice; of notices of one width that a block holds,
        those with the largest containment."""
        x = np.where(x < self.rare, x, -1)
        wanted: dict[tuple[int, int], tuple[int, int]] = {}
        for p in np.flatnonzero(self.first[x]):
            r = int(x[p])
            for k, i in self.prefix[r]:
                at = int(p) // self.notices[k].width
                for block in (at - 1, at) if at else (at,):
                    wanted[k, block] = min(wanted.get((k, block), (i, r)), (i, r))  # the first common word
        found: dict[tuple[int, int], list] = {}
        for (k, block), (i, r) in wanted.items():
            notice, own = self.notices[k], self.sets[k]
            start = block * notice.width
            part = x[start : start + 2 * notice.width]
            there = np.unique(part[part >= 0])
            j = int(np.searchsorted(there, r))
            if len(there) < notice.least or 1 + min(len(own) - i, len(there) - j) - 1 < notice.least:
                continue
            both = int(np.isin(own, there, assume_unique=True).sum())
            if both >= notice.least and np.isin(self.needs[k], there).all():
                found.setdefault((notice.width, block), []).append((k, start, len(part), both / len(own)))
        best = []
        for rows in found.values():
            most = max(c for *_, c in rows)
            best += [row for row in rows if row[3] == most]
        return sorted(best, key=lambda row: (row[1], row[0]))


FOUND = "array<struct<label:string,notice:int,start:long,words:int,containment:double>>"


def scan(docs: DataFrame, rows=NOTICES, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, places (place and label of each base phrase), blocks (each
    block that holds a notice: label, notice, first word, words, containment).

    Two scans of the whole texts; nothing is shuffled but the counts of the notices' words.  Null and empty texts have no
    words and empty lists; rows that repeat an id are judged by their own texts; a phrase that several places share is
    found at each, and notices that tie in a block are all kept.  A long text is cut into words a piece at a time.  Extra
    columns are ignored; an empty table gives no rows.
    """
    found = notices(rows, share)
    index = Index(found, frequencies(docs, sorted({w for x in found for w in (*x.words, *x.needs)})))

    def run(batches):
        for b in batches:
            n, places, blocks = [], [], []
            for x in numbered(b.column("text").to_pylist(), index.ranks):
                n.append(len(x))
                places.append([{"place": p, "label": label} for p, label in sorted(index.base(x))])
                blocks.append([{"label": found[k].label, "notice": k, "start": s, "words": w, "containment": c} for k, s, w, c in index.blocks(x)])
            kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("start", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())]))), pa.array(blocks, kind)], ["doc_id", "n_words", "places", "blocks"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), f"doc_id long, n_words long, places array<struct<place:long,label:string>>, blocks {FOUND}")


def labelled(scanned: DataFrame) -> DataFrame:
    """Per row: n_base, first_word, last_word, base_labels, labels and score (1 with a base phrase, else the largest
    containment of a notice, 0 without any)."""
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, own, place = F.col("places.label"), F.col("blocks.label"), F.col("places.place")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"),
    )
