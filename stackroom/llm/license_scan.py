"""License scans with a positional index of rare words.

Each licence template's words are indexed by position. The corpus gives each licence word its
inverse document frequency (counted over all documents). Per file, the licence words with the
highest values are looked up; their template postings, shifted by where the word stands in the
file, vote for places where the template may begin, and a place with votes of several words is
verified: every mandatory key phrase must stand at its own place in the template (within a few
words), and the share of the template's words found there is the score. Key phrases given as
plain `phrases` are labels of their own wherever their words stand consecutively.

Only files that hold the rarest word of some mandatory phrase can verify, so only those are
looked into word by word; all words of all files are read.

Defined cases: null and empty texts have no words, no labels, score 0; an empty table gives no
rows; ties between words of equal frequency go to the word that sorts first; repeated rows get
equal results. Other columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.arrow_text import ALNUM_LOWER, Tokens, slices, split_words, tokenize, word_hashes

#: Label by phrase.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, usual notice, mandatory key phrases. Notices of public licences.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
]

#: Licence words looked up per template and file, rarest first.
RAREST = 6
#: Words that must vote for the same place.
LEAST_VOTES = 2
#: By how many words a place may be off (inserted or dropped words).
SLACK = 2
LEAST_SCORE = 0.5


@dataclass
class Index:
    words: list[bytes]
    hashes: np.ndarray  #: sorted, as words
    templates: list[tuple[str, list[int], list[tuple[int, list[int]]]]]  #: label, words, key phrases with their place
    phrases: list[tuple[str, list[int]]]
    idf: list[float] = field(default_factory=list)
    gates: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def build_index(templates=TEMPLATES, phrases=PHRASES) -> Index:
    words = sorted({w for t in [*(x for _, x, _ in templates), *(p for _, _, ps in templates for p in ps), *phrases] for w in split_words(t, ALNUM_LOWER) if w})
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    number = {words[k]: i for i, k in enumerate(order.tolist())}
    ids = lambda t: [number[w] for w in split_words(t, ALNUM_LOWER) if w]
    made = []
    for label, text, keys in templates:
        body = ids(text)
        placed = []
        for key in map(ids, keys):
            placed.append((next(i for i in range(len(body)) if body[i : i + len(key)] == key), key))
        made.append((label, body, placed))
    return Index([words[k] for k in order.tolist()], hashes[order], made, [(label, ids(p)) for p, label in phrases.items()])


def weigh(index: Index, docs: DataFrame, text_col: str = "text") -> Index:
    """Give each licence word its inverse document frequency over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(index.words), np.int64)
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), ALNUM_LOWER)
            ids = index.numbers(tok.hash)
            here = ids >= 0
            n += b.num_rows
            df += np.bincount(np.unique(tok.row_of()[here] * len(df) + ids[here]) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_pydict({"word": [*range(len(df)), -1], "n": [*df.tolist(), n]}, schema=pa.schema([("word", pa.int32()), ("n", pa.int64())]))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in found.collect()}  # a row for each licence word
    total = got.get(-1, 0)
    index.idf = [math.log((1 + total) / (1 + got.get(i, 0))) for i in range(len(index.words))]
    index.gates = np.zeros(len(index.words), bool)
    for _, _, keys in index.templates:
        index.gates[max(keys[0][1], key=lambda w: (index.idf[w], -w))] = True
    return index


def consecutive(ids: np.ndarray, rows: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after another within a text."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = ids[:n] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        hit &= ids[k : n + k] == w
    at = np.flatnonzero(hit)
    end = rows[np.searchsorted(rows, at, side="right")]
    return at[at + len(phrase) <= end]


def look_up(index: Index, ids: list[int]) -> dict[str, float]:
    """Labels of the templates verified in a file's words, each with its best score."""
    where: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(ids):
        if w >= 0:
            where[w].append(i)
    out: dict[str, float] = {}
    for label, body, keys in index.templates:
        if any(w not in where for _, key in keys for w in key):
            continue
        rare = sorted({w for w in body if w in where}, key=lambda w: (-index.idf[w], w))[:RAREST]
        votes: dict[int, set[int]] = defaultdict(set)
        for j, w in enumerate(body):
            if w in rare:
                for i in where[w]:
                    votes[i - j].add(w)
        for place, voters in votes.items():
            near = set(voters).union(*(votes[place + d] for d in range(-SLACK, SLACK + 1) if place + d in votes))
            if len(near) < LEAST_VOTES:
                continue
            ok = all(any(ids[max(place + at + d, 0) : max(place + at + d, 0) + len(key)] == key for d in range(-SLACK, SLACK + 1)) for at, key in keys)
            if ok:
                there = sum(1 for j, w in enumerate(body) if any(0 <= place + j + d < len(ids) and ids[place + j + d] == w for d in range(-SLACK, SLACK + 1)))
                score = there / len(body)
                if score >= LEAST_SCORE:
                    out[label] = max(out.get(label, 0.0), score)
    return out


COLUMNS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """All columns with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    sent = docs.sparkSession.sparkContext.broadcast(weigh(build_index(templates, phrases), docs, text_col))
    kept = [f for f in docs.schema.fields if f.name not in dict(COLUMNS)]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in COLUMNS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in slices(batches, text_col):
            tok: Tokens = tokenize(b.column(text_col), ALNUM_LOWER)
            ids = index.numbers(tok.hash) if len(tok.hash) else np.zeros(0, np.int64)
            base: list[list[int]] = [[] for _ in range(b.num_rows)]
            base_labels: list[set[str]] = [set() for _ in range(b.num_rows)]
            for label, phrase in index.phrases:
                for at in consecutive(ids, tok.rows, phrase).tolist():
                    i = int(np.searchsorted(tok.rows, at, side="right")) - 1
                    base[i].append(at - int(tok.rows[i]))
                    base_labels[i].add(label)
            labels = [set(x) for x in base_labels]
            score = [1.0 if x else 0.0 for x in base_labels]
            gated = np.flatnonzero(index.gates[ids] & (ids >= 0)) if len(ids) else ids
            for i in np.unique(np.searchsorted(tok.rows, gated, side="right") - 1).tolist():
                found = look_up(index, ids[tok.rows[i] : tok.rows[i + 1]].tolist())
                labels[i] |= found.keys()
                score[i] = max([score[i], *found.values()])
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(f.name) for f in kept), pa.array(np.diff(tok.rows)), pa.array([len(x) for x in base], pa.int64()), pa.array([min(x) if x else None for x in base], pa.int64()), pa.array([max(x) if x else None for x in base], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                ],
                names=schema.names,
            )

    return docs.select(*[f.name for f in kept]).mapInArrow(find, schema)
