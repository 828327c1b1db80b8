"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words.  A block is a window of consecutive words, overlapping by half and at least
twice as long as the template, so that every place where a template could stand lies inside some block.  A
block meets a template when it holds ``threshold`` of the template's words.

1. One pass counts the template words over the whole corpus; that orders each template from its rarest word
   to its most frequent one.  The counts are one row for each template word, whatever the corpus.
2. The prefix filter: a block without any of a template's ``|T| - need + 1`` rarest words cannot hold
   ``need`` of them, so only windows around those rare words become candidates.
3. The length filter drops candidates with fewer than ``need`` template words in all; the positional filter
   those where too few words follow the first shared one, in the block's or the template's order.
4. What is left is counted exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Notices by which the public licenses ask to be named, characteristic paragraphs of their texts, and labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public"),
    ("agpl", "GNU Affero General Public"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users"),
    ("agpl", "If your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source"),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
#: The phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
THRESHOLD = 0.8

COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:int,label:string,start_word:long,end_word:long,containment:double>>"


def words_of(raw: bytes) -> list[bytes]:
    """The distinct words of a text, in order."""
    data = K.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = K.word_spans(K.Texts(data, np.array([0]), np.array([len(data)])), K.LETTERS)
    return list(dict.fromkeys(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())))


def _hash(word: bytes) -> int:
    return int(K.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


class Vocabulary:
    """The words of all templates and phrases, by ascending hash."""

    def __init__(self, templates):
        words = {w for _, t in templates for w in words_of(t.encode())} | {w for p, _ in PHRASES for w in words_of(p.encode())}
        self.words = sorted(words, key=_hash)
        self.hashes = np.array([_hash(w) for w in self.words], np.uint64)
        self.number = {w: i for i, w in enumerate(self.words)}

    def find(self, texts: K.Texts):
        """Words in each text (as first-word indices), places of vocabulary words, and their numbers."""
        texts = K.Texts(K.LOWER[texts.data], texts.starts, texts.ends)
        starts, ends, first = K.word_spans(texts, K.LETTERS)
        hashes = K.span_hashes(texts.data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return first, hit, at[hit]


def word_counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """How often each vocabulary word stands in the whole corpus; every task sends one row a word at most."""
    K.prepare(docs.sparkSession)

    def run(batches):
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, texts in K.blocks(batch, "t"):
                total += np.bincount(vocabulary.find(texts)[2], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


class Index:
    """Templates with their words in global order, what they need, and their prefixes by word."""

    def __init__(self, templates, threshold: float, vocabulary: Vocabulary, counts: np.ndarray):
        self.order = np.lexsort((vocabulary.hashes, counts)).argsort()  # place of each word in the global order
        self.labels = [label for label, _ in templates]
        self.words, self.need, self.window, self.prefix = [], [], [], []
        for _, text in templates:
            own = sorted((vocabulary.number[w] for w in words_of(text.encode())), key=lambda w: self.order[w])
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            self.words.append(np.array(own))
            self.need.append(need)
            self.prefix.append(np.array(own[: len(own) - need + 1]))
            span = len(text.split()) + text.count("-") + text.count(".") + text.count("/")
            self.window.append(1 << math.ceil(math.log2(2 * span)))
        self.longest = max(self.window)
        #: The templates that have a word in their prefix.
        self.by_word: dict[int, list[int]] = {}
        for t, prefix in enumerate(self.prefix):
            for w in prefix.tolist():
                self.by_word.setdefault(w, []).append(t)

    def scan(self, place: np.ndarray, word: np.ndarray, n_words: int) -> list[tuple[int, int, int, float]]:
        """``template, start, end, containment`` of the blocks of one text that meet a template.

        ``place`` and ``word`` are the places and numbers of vocabulary words.
        """
        out = []
        # the work follows the prefix words that the text has, not the number of templates
        for t in sorted({t for w in np.unique(word).tolist() for t in self.by_word.get(w, ())}):
            own = self.words[t]
            rare = place[np.isin(word, self.prefix[t])]
            step = self.window[t] // 2
            last = max(0, -(-n_words // step) - 2)  # the last block ends with the text
            for b in np.unique(np.minimum(np.concatenate([rare // step, np.maximum(rare // step - 1, 0)]), last)).tolist():
                lo, hi = np.searchsorted(place, [b * step, b * step + self.window[t]])
                block = np.unique(word[lo:hi])
                if len(block) < self.need[t]:  # length filter
                    continue
                block = block[np.argsort(self.order[block])]
                shared = np.isin(block, own)
                j = int(shared.argmax())
                i = int(np.flatnonzero(own == block[j])[0]) if shared[j] else len(own)
                if min(len(own) - i, len(block) - j) < self.need[t]:  # positional filter
                    continue
                found = int(shared.sum())
                if found >= self.need[t]:
                    out.append((t, b * step, min(n_words, b * step + self.window[t]), found / len(own)))
        return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, word counts, base phrases, labels, score and all matching blocks for every row of ``docs``.

    ``score`` is the largest containment of a matching block, 1 where a base phrase stands, else 0.  A null or
    empty text has no words: counts 0, places null, labels empty.  Repeated rows, null keys and ties are
    rows like any other; an empty table gives none; other columns are not read.
    """
    vocabulary = Vocabulary(templates)
    index = Index(templates, threshold, vocabulary, word_counts(docs, text, vocabulary))
    kind = docs.schema[key].dataType.simpleString()
    phrases = [([vocabulary.number[w.encode()] for w in p.split()], label) for p, label in PHRASES]
    rare = np.unique(np.concatenate([*index.prefix, np.array([p[0] for p, _ in phrases])]))

    def block(rows, texts):
        first, place, word = vocabulary.find(texts)
        n_words = np.diff(first)
        lows, highs = np.searchsorted(place, first[:-1]), np.searchsorted(place, first[1:])
        some = np.concatenate([[0], np.cumsum(np.isin(word, rare))])
        out: list[tuple] = [(int(n), 0, None, None, "", "", 0.0, []) for n in n_words]
        for i in np.flatnonzero(some[highs] > some[lows]).tolist():
            at, own = place[lows[i] : highs[i]] - first[i], word[lows[i] : highs[i]]
            base: list[tuple[int, str]] = []
            for numbers, label in phrases:
                hit = at[own == numbers[0]]
                for k, number in enumerate(numbers[1:], 1):
                    hit = hit[np.isin(hit + k, at[own == number])]
                base += [(int(h), label) for h in hit]
            found = index.scan(at, own, int(n_words[i]))
            starts, names = [h for h, _ in base], {label for _, label in base}
            labels = names | {index.labels[t] for t, *_ in found}
            score = max([1.0] * bool(base) + [f[3] for f in found], default=0.0)
            matches = [{"template": t, "label": index.labels[t], "start_word": a, "end_word": b, "containment": c} for t, a, b, c in found]
            out[i] = (int(n_words[i]), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(labels)), score, matches)
        match = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return K.arrow_map(base, block, f"k {kind}, {COLUMNS}", "t").withColumnRenamed("k", key)
