"""Licence scan with a positional rare-token index (operator 5).

The index holds the words of the licence notices and SPDX lines below with their positions. A word counts in
any of its spellings (licence for license, a plural s more or less).

1. *Rare words.* Inverse document frequencies are counted over the whole corpus; a template of n words is represented by its
   n / 5 + 2 rarest distinct ones. Only these are looked up in a file, wherever they stand.
2. *Relative positions.* A rare word at position p of the file that stands at q in a template votes for the place p - q.
   Votes of two different rare words (of one, where a template has just one) that lie within the template's
   slack of each other make a candidate. Up to a fifth of a template's words may be missing, changed, or pushed
   apart, so of n / 5 + 2 rare words at least two always vote: no notice is lost to the index.
3. *Verification.* The best window at the candidate has to hold ``MIN_COVER`` of the template's words in order, and in it
   one of the mandatory key phrases: short ones (up to ``WHOLE_KEY`` words: names and versions, SPDX lines) whole and without a gap,
   longer ones in order, with one changed word for every five but all of their numbers.

Base phrases (``BASE``) are found wherever their words stand consecutively, exactly as spelled; their labels
always stay, whatever the index says.

``score`` is the best verified cover, 1 for a base phrase that stands alone, 0 without any label.

Cases: a null or empty text has no words, no labels and score 0; rows are judged one by
one, so repeated or null ids are returned as they came; of equally good windows the first counts; other columns are ignored; an empty
table gives an empty result. A very long text is looked up whole, all of its notices are found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.tables import arrow_map

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values: (label, notice text, mandatory key phrases) of well-known public licences.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
     ("gnu general public license as published by the free software foundation either version 3",)),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
     ("gnu general public license as published by the free software foundation either version 2",)),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "this work is licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     ("you may not use this file except in compliance with the license", "www apache org licenses license 2 0")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software for any purpose",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
     ("in no event will the authors be held liable for any damages arising from the use of this software",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
)
# SPDX names and their labels.
SPDX = {"MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "BSD-2-Clause": "bsd",
        "BSD-3-Clause": "bsd", "ISC": "isc", "MPL-2.0": "mpl-2.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0", "Unlicense": "unlicense",
        "Zlib": "zlib", "BSL-1.0": "bsl-1.0"}


def _spdx(name: str) -> str:
    return "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())


TEMPLATES = NOTICES + tuple((label, _spdx(name), (_spdx(name).removeprefix("spdx license "),)) for name, label in SPDX.items())
MIN_COVER, BEST_KNOWN, WHOLE_KEY = 0.8, 1.0, 6
MEMO = 1 << 14  # remembered windows a worker


def spellings(word: str) -> set[str]:
    """The spellings that count as a word of a template."""
    out = {word, word + "s"} | ({word[:-1]} if word.endswith("s") and len(word) > 3 else set())
    out |= {w.replace("license", "licence") for w in out} | {w.replace("licence", "license") for w in out}
    return out if len(word) > 2 else {word}


def slack(n: int) -> int:
    """Words of a template of n that may be missing, and that may stand between its others."""
    return n - math.ceil(MIN_COVER * n - 1e-9)


def in_order(seq: list[int], window: list[int]) -> int:
    """How many words of ``seq`` stand in ``window`` in order (longest common subsequence, bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(seq):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(seq)) - 1
    v = full
    for w in window:
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(seq) - v.bit_count()


def holds(key: list[int], numerals: list[int], window: list[int]) -> bool:
    """Whether a key phrase stands in a window: short ones without a gap, long ones with one changed word for every five, but all numbers."""
    if len(key) <= WHOLE_KEY:
        return any(window[i:i + len(key)] == key for i in range(len(window) - len(key) + 1))
    return in_order(key, window) >= len(key) - len(key) // 5 and in_order(numerals, window) == len(numerals)


class Index:
    """Licence words with their postings: (template, position) per word id."""

    def __init__(self) -> None:
        texts = [t.split(" ") for _, t, _ in TEMPLATES]
        phrases = [p.split(" ") for _, _, ps in TEMPLATES for p in ps] + [p.split(" ") for p in BASE]
        self.vocabulary = sorted({w for t in texts + phrases for w in t})
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        # words that are spellings of each other count as one: the smallest id stands for all
        form = {}
        for w in self.vocabulary:
            for x in sorted(spellings(w)):
                form.setdefault(x, ids[min(spellings(w) & ids.keys() | {w})])
        self.form = np.array([form[w] for w in self.vocabulary])
        self.exact = self._table(self.vocabulary, np.arange(len(self.vocabulary)))
        forms = sorted(form)
        self.forms = self._table(forms, np.array([form[w] for w in forms]))
        one = lambda words: [int(self.form[ids[w]]) for w in words]
        self.templates = [one(t) for t in texts]
        self.keys = [[one(k.split(" ")) for k in ks] for _, _, ks in TEMPLATES]
        self.numerals = [[[k for k in key if self.vocabulary[k].isdigit()] for key in keys] for keys in self.keys]
        self.base = [(np.array([ids[w] for w in p.split(" ")]), label) for p, label in BASE.items()]

    @staticmethod
    def _table(words: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, value per hash) of words."""
        joined = " ".join(words).encode()
        h = W.Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), W.ALNUM).hashes()
        order = np.argsort(h)
        return h[order], values[order]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return np.where(table[0][i] == h, table[1][i], -1)

    def rare(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(word, template, position) of the rare words' postings, sorted by word, and the votes each template needs."""
        rows, need = [], []
        for t, seq in enumerate(self.templates):
            distinct = sorted(set(seq), key=lambda w: (-idf[w], w))[: len(seq) // 5 + 2]
            need.append(min(2, len(distinct)))
            rows += [(w, t, q) for q, w in enumerate(seq) if w in distinct]
        rows.sort()
        word, template, position = (np.array(x) for x in zip(*rows))
        return word, template, position, need

    def ids(self, w: W.Words) -> np.ndarray:
        """Word id of every word of the block as spelled, -1 for words of no licence."""
        return self._look(self.exact, w.hashes())

    def formed(self, w: W.Words) -> np.ndarray:
        """The same with every spelling."""
        return self._look(self.forms, w.hashes())

    def stands(self, w: W.Words, at: int, seq: np.ndarray) -> bool:
        """The hashes only propose: the words themselves, byte by byte."""
        return all(w._as_byte[w.data[w.starts[at + j]:w.ends[at + j]]].tobytes() == self.vocabulary[k].encode() for j, k in enumerate(seq.tolist()))

    def present(self, w: W.Words, ids: np.ndarray) -> np.ndarray:
        """Which licence words each row of the block holds."""
        out = np.zeros((w.n_rows, len(self.vocabulary)), dtype=bool)
        at = np.flatnonzero(ids >= 0)
        out[w.row_of_word()[at], ids[at]] = True
        return out


def _frequencies():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        size = len(index.vocabulary)
        for batch in batches:
            counts = np.zeros(size, dtype=np.int64)
            for _, _, w in W.blocks(batch, "text", W.ALNUM):
                counts += index.present(w, index.formed(w)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(counts)], names=["word", "n"])

    return run


def _consecutive(ids: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places in a block where the phrase's words stand consecutively in one row."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at[row[at] == row[at + len(phrase) - 1]]


def _candidates(index: Index, rare, ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, template, lowest, highest place) where rare words agree on a place within the template's slack."""
    word, template, position, need = rare
    at = np.flatnonzero(ids >= 0)
    lo, hi = np.searchsorted(word, ids[at]), np.searchsorted(word, ids[at], side="right")
    n = hi - lo
    at, posting = np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, t, r, w = at - position[posting], template[posting], row[at], ids[at]
    order = np.lexsort((place, t, r))
    place, t, r, w = place[order], t[order], r[order], w[order]
    room = np.array([2 * slack(len(s)) for s in index.templates])
    new = np.ones(len(order), dtype=bool)  # a cluster ends where the next vote is out of reach
    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (place[1:] - place[:-1] > room[t[1:]])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(order))
    out = []
    for a, b in zip(start.tolist(), end.tolist()):
        if b - a >= need[t[a]] and len(set(w[a:b].tolist())) >= need[t[a]]:
            out.append((int(r[a]), int(t[a]), int(place[a]), int(place[b - 1])))
    return out


def best_window(index: Index, t: int, ids: list[int], first: int, last: int) -> tuple[int, float] | None:
    """(start, cover) of the best verified window of template t that starts between first and last."""
    seq = index.templates[t]
    free, best = slack(len(seq)), None
    for a in range(max(first, 0), min(last, len(ids) - 1) + 1):
        window = ids[a:a + len(seq) + free]
        cover = in_order(seq, window) / len(seq)
        if cover >= MIN_COVER and (best is None or cover > best[1]) and any(holds(k, d, window) for k, d in zip(index.keys[t], index.numerals[t])):
            best = a, cover
            if cover == 1.0:
                break
    return best


def _verified(index: Index, ids: np.ndarray, candidate: tuple[int, int, int, int], memo: dict) -> tuple[int, int, float] | None:
    """(template, start, cover) of a candidate in one file's word ids."""
    _, t, low, high = candidate
    n = len(index.templates[t])
    first, last = low - slack(n), high + slack(n)
    lo, hi = max(first, 0), min(last + n + slack(n), len(ids))
    part = ids[lo:hi]
    key = (t, first - lo, last - first, part.tobytes())
    if key not in memo:
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = best_window(index, t, part.tolist(), first - lo, last - lo)
    found = memo[key]
    return found and (t, lo + found[0], found[1])


def _scan(idf: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = Index(), {}
        rare = index.rare(np.array(idf))
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.ALNUM):
                ids, row = index.ids(w), w.row_of_word()
                n = w.n_rows
                n_base = np.zeros(n, dtype=np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
                base: list[set] = [set() for _ in range(n)]
                for phrase, label in index.base:
                    at = _consecutive(ids, row, phrase)
                    at = at[[index.stands(w, i, phrase) for i in at.tolist()]] if len(at) else at
                    r, p = row[at], at - w.first[row[at]]
                    np.add.at(n_base, r, 1)
                    np.minimum.at(first, r, p)
                    np.maximum.at(last, r, p)
                    for i in np.unique(r).tolist():
                        base[i].add(label)
                found: list[list] = [[] for _ in range(n)]
                formed = index.formed(w)
                for c in _candidates(index, rare, formed, row):
                    begin = int(w.first[c[0]])
                    here = (c[0], c[1], c[2] - begin, c[3] - begin)
                    hit = _verified(index, formed[begin:w.first[c[0] + 1]], here, memo)
                    if hit:
                        found[c[0]].append(hit)
                labels = [",".join(sorted(b | {TEMPLATES[t][0] for t, _, _ in f})) for b, f in zip(base, found)]
                score = [max([c for _, _, c in f] + [BEST_KNOWN if b else 0.0]) for b, f in zip(base, found)]
                spans = [[{"label": TEMPLATES[t][0], "from": a, "cover": c} for t, a, c in sorted(f, key=lambda x: (x[1], x[0]))] for f in found]
                none = last < 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                     pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()),
                     pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("cover", pa.float64())])))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = arrow_map(docs.select("text"), _frequencies(), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = dict(counted.collect())  # one row per licence word: bounded by the templates
    top = max(df.values(), default=0) + 1
    idf = [float(np.log(top / (1 + df.get(i, 0)))) for i in range(len(Index().vocabulary))]
    out = T.StructType([T.StructField("id", docs.schema["id"].dataType)] + T._parse_datatype_string(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "notices array<struct<label:string,from:long,cover:double>>").fields)
    return arrow_map(docs, _scan(idf), out).withColumnRenamed("id", id_col)
