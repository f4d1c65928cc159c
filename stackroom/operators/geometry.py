"""Boxes of OCR words for the words of a page's text.

Words that both sides have once are fixed points where they stand in the same order; between them
words are paired in order: equal ones, ones that differ by one edit, one word that OCR cut in two,
two that it ran together. Stretches too long to compare within the budget are left without boxes.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

BUDGET = 2_000_000
_TOKEN = re.compile(r"\S+")

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Placed:
    """A word of the text at [start, end) with its box, or without one (kind none)."""

    start: int
    end: int
    kind: str  #: exact, near, cut (by OCR in two), run (together with its neighbour), none
    box: Box | None = None


def _key(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", word).casefold() if c.isalnum()) or word


def one_edit(a: str, b: str) -> bool:
    """At most one character changed, added or dropped, in words of four characters or more."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + (len(a) > len(b)) :] == b[k + (len(b) > len(a)) :]


def union(*boxes: Box) -> Box:
    x1, y1, x2, y2 = zip(*boxes, strict=True)
    return min(x1), min(y1), max(x2), max(y2)


def _fixed(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Words that stand once on each side, as the longest run of pairs in the same order on both."""
    na, nb = Counter(a), Counter(b)
    at = {w: j for j, w in enumerate(b) if nb[w] == 1}
    pairs = [(i, at[w]) for i, w in enumerate(a) if na[w] == 1 and w in at]
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(ends, j)
        ends[p:], tails[p:] = [j, *ends[p + 1 :]], [k, *tails[p + 1 :]]
        before.append(tails[p - 1] if p else -1)
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _between(a: list[str], b: list[str]) -> list[tuple[int, int, int, int, str]]:
    """(first, end) in a with (first, end) in b and a kind, of the pairing that covers most characters."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    move: list[list[tuple[int, int, str] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m, -1, -1):
            top, step = best[i + 1][j], (1, 0, "none")
            if j < m:
                options = [(best[i][j + 1], (0, 1, "none"))]
                if a[i] == b[j]:
                    options.append((best[i + 1][j + 1] + len(a[i]), (1, 1, "exact")))
                elif one_edit(a[i], b[j]):
                    options.append((best[i + 1][j + 1] + len(a[i]) - 1.5, (1, 1, "near")))
                if j + 1 < m and a[i] == b[j] + b[j + 1]:
                    options.append((best[i + 1][j + 2] + len(a[i]) - 0.5, (1, 2, "cut")))
                if i + 1 < n and a[i] + a[i + 1] == b[j]:
                    options.append((best[i + 2][j + 1] + len(b[j]) - 0.5, (2, 1, "run")))
                for value, way in options:
                    if value > top:
                        top, step = value, way
            best[i][j], move[i][j] = top, step
    out, i, j = [], 0, 0
    while i < n:
        di, dj, kind = move[i][j]
        if kind != "none":
            out.append((i, i + di, j, j + dj, kind))
        i, j = i + di, j + dj
    return out


def align(text: str, words: list[tuple[str, Box]], budget: int = BUDGET) -> list[Placed]:
    """Every word of the text in order, with the box of what OCR read for it."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    a, b = [_key(text[s:e]) for s, e in spans], [_key(w) for w, _ in words]
    placed: dict[int, tuple[str, Box]] = {}
    fixed = _fixed(a, b)
    for i, j in fixed:
        placed[i] = "exact", words[j][1]
    for (i1, j1), (i2, j2) in zip([(-1, -1), *fixed], [*fixed, (len(a), len(b))], strict=True):
        cells = (i2 - i1 - 1) * (j2 - j1 - 1)
        if not cells or cells > budget:
            continue
        budget -= cells
        for s, e, x, y, kind in _between(a[i1 + 1 : i2], b[j1 + 1 : j2]):
            box = union(*(words[j1 + 1 + k][1] for k in range(x, y)))
            for k in range(s, e):
                placed[i1 + 1 + k] = kind, box
    return [Placed(s, e, *placed.get(k, ("none", None))) for k, (s, e) in enumerate(spans)]


def align_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, start, end, kind, left, top, right, bottom for rows of (key, text, words); words hold text and box."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, start int, end int, kind string, left double, top double, right double, bottom double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, text, words in zip(pdf[key], pdf["text"], pdf["words"], strict=True):
                found = align(text or "", [(w["text"], tuple(w["box"])) for w in (words if words is not None else ())])
                rows += [(page, p.start, p.end, p.kind, *(p.box or (None,) * 4)) for p in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.select(key, "text", "words").mapInPandas(run, schema)
