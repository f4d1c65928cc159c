"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The items' words become numbers, and one automaton holds every run of words of every item. Each
document's words are streamed through it, tracking the length of the longest run that ends at
each word; a run of `window` words or more (or a whole item that is shorter) marks its words as
hit. Only stretches whose neighbouring words are also neighbours in some item are streamed, as a
run of two words or more holds no other pair; one-word items switch that filter off.

Items are small beside the corpus, but not bounded: an automaton holds at most `most_words` item
words (a longer item is dealt to several in parts that overlap by a window less one word). With
more words than that, automata are built, sent and dropped one at a time: each passes over the
texts and its hits are written by the text's digest, and the hits of all are joined with the
documents in the end. So the driver and each task hold one automaton, whatever the number of items.

Defined cases: null and empty texts have no words and no hits; items without words are ignored;
repeated items count once by item_id; an empty items table hits nothing; rows are independent.
Other columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.arrow_text import ALNUM_LOWER, Tokens, list_array, slices, split_words, tokenize, word_hashes
from stackroom.session import cut

WINDOW = 10
#: Item words in one automaton (about 2 states of some 200 bytes for each).
MOST_WORDS = 500_000
#: Columns that find_overlaps makes.
MADE = ["n_words", "spans", "items", "clean_text"]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Automaton:
    """Generalised suffix automaton over numbered words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        words = sorted({w for _, ws in items for w in ws})
        self.hashes = word_hashes(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        number = {words[k]: i for i, k in enumerate(order.tolist())}
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [number[w] for w in ws]) for name, ws in items]
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}  #: by the state whose runs include a whole window
        self.short: dict[int, int] = {}  #: length of a whole short item that ends in that state
        for name, ids in texts:
            n = min(window, len(ids))
            if n:
                for state in self._ends(ids, n):
                    self.items.setdefault(state, set()).add(name)
                    if n < window:
                        self.short[state] = n
        pairs = {a * len(words) + b for _, ids in texts for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *(len(ids) for _, ids in texts if ids)])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # the run is there already, from another item
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest known run that ends with w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def _ends(self, ids: list[int], n: int) -> Iterator[int]:
        """The state that holds each run of n words of an item."""
        state = length = 0
        for k, w in enumerate(ids):
            state, length = self.step(state, length, w)
            if k >= n - 1:
                at = state
                while self.length[self.link[at]] >= n:
                    at = self.link[at]
                yield at

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def stretches(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of the words in which each pair stands in some item, of `least` words at least, within one text."""
        if self.least < 2:
            linked = np.ones(max(len(ids) - 1, 0), bool)
        else:
            key = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.hashes) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        inner = rows[(rows > 0) & (rows < len(ids))]
        linked[inner - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
        if self.least < 2:
            edges = np.stack([np.unique(np.concatenate([[0], inner])), np.unique(np.concatenate([inner, [len(ids)]])) - 1], 1).ravel() if len(ids) else edges
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a + 1 >= self.least:
                yield a, b + 1

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of a stretch of words, merged, and the items whose windows occur."""
        state = length = 0
        spans: list[list[int]] = []
        found: set[str] = set()
        for i, w in enumerate(ids):
            state, length = self.step(state, length, w) if w >= 0 else (0, 0)
            reach = 0
            if length >= self.window:
                reach = length
            at, have = state, length
            while at:
                if have >= self.window and self.length[self.link[at]] < self.window or self.short.get(at, self.window) <= have and at in self.short:
                    found |= self.items.get(at, set())
                    if at in self.short and self.short[at] <= have:
                        reach = max(reach, self.short[at])
                at = self.link[at]
                have = self.length[at]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def shards(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", most_words: int = MOST_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in groups of most_words at most, streamed; one empty group if there are none."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & F.col("item").isNotNull()).distinct()
    most_words = max(most_words, window)
    held, size, none = [], 0, True
    for r in rows.sort("item", "text").toLocalIterator():
        ws = split_words(r["text"], ALNUM_LOWER)
        for k in range(0, max(len(ws) - window + 1, 1), most_words - window + 1):
            part = ws[k : k + most_words]
            if held and size + len(part) > most_words:
                yield held
                held, size, none = [], 0, False
            held.append((r["item"], part))
            size += len(part)
    if held or none:
        yield held


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """All columns with n_words, spans (of hit words, merged and in order), items (whose windows occur) and clean_text.

    clean_text is the text without the bytes from each hit span's first word to its last.
    """
    groups = shards(items, window, item_col, item_text_col, most_words)
    first, second = next(groups), next(groups, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(first, window))
        kept = [c for c in docs.columns if c not in MADE]
        return _marked(docs.select(*dict.fromkeys([*kept, text_col])), kept, text_col, lambda b, tok: _find(sent.value, tok))
    texts = docs.select(F.col(text_col).alias("text"))
    hits = reduce(DataFrame.unionByName, (_hits(texts, Automaton(g, window)) for g in chain([first, second], groups)))
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), _digest(text_col).alias("key")).join(hits, "key", "left")

    def known(b: pa.RecordBatch, tok: Tokens) -> tuple[dict, dict]:
        held = [(i, s, m) for i, (s, m) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)) if s]
        return {i: [(x["start"], x["end"]) for x in s] for i, s, _ in held}, {i: set(m) for i, _, m in held}

    marked = _marked(rows, ["row"], "text", known)
    return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in MADE], *MADE)


def _digest(text_col: str) -> Column:
    return F.sha2(F.col(text_col), 256)


def _find(a: Automaton, tok: Tokens) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Hit spans and the items whose windows occur, by text."""
    ids = a.numbers(tok.hash)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for begin, end in a.stretches(ids, tok.rows) if len(ids) else ():
        found, names = a.scan(ids[begin:end].tolist())
        if found:
            i = int(np.searchsorted(tok.rows, begin, side="right")) - 1
            first = begin - int(tok.rows[i])
            spans.setdefault(i, []).extend((x + first, y + first) for x, y in found)
            items.setdefault(i, set()).update(names)
    return spans, items


def _hits(texts: DataFrame, automaton: Automaton) -> DataFrame:
    """key, spans, items of each distinct text that one automaton hits, written; the automaton is given up afterwards."""
    sent = texts.sparkSession.sparkContext.broadcast(automaton)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            spans, items = _find(sent.value, tokenize(b.column("text"), ALNUM_LOWER))
            if spans:
                hit = sorted(spans)
                pairs = pa.array([[{"start": x, "end": y} for x, y in merged(spans[i])] for i in hit], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(hit)), pairs, pa.array([sorted(items[i]) for i in hit], pa.list_(pa.string()))], names=schema.names)

    found = cut(texts.select("text", _digest("text").alias("key")).mapInArrow(run, schema).dropDuplicates(["key"]))
    sent.destroy()
    return found


def _marked(docs: DataFrame, columns: list[str], text_col: str, find: Callable[[pa.RecordBatch, Tokens], tuple[dict, dict]]) -> DataFrame:
    """The columns with n_words, spans, items and clean_text, by what find() says of each batch."""
    kept = [docs.schema[c] for c in columns]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            tok = tokenize(b.column(text_col), ALNUM_LOWER)
            spans, items = find(b, tok)
            texts = b.column(text_col)
            clean = None
            if spans:
                clean = texts.to_pylist()
                for i in spans:
                    spans[i] = merged(spans[i])
                    raw, at, pieces, begin = clean[i].encode(), 0, [], int(tok.offsets[i])
                    for x, y in spans[i]:
                        pieces.append(raw[at : int(tok.begin[tok.rows[i] + x]) - begin])
                        at = int(tok.end[tok.rows[i] + y - 1]) - begin
                    clean[i] = b"".join([*pieces, raw[at:]]).decode()
            per_row = [spans.get(i, ()) for i in range(b.num_rows)]
            rows = np.concatenate([[0], np.cumsum([len(s) for s in per_row])])
            flat = [x for s in per_row for x in s]
            pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in kept), pa.array(np.diff(tok.rows)), list_array(pairs, rows), pa.array([sorted(items.get(i, ())) for i in range(b.num_rows)], pa.list_(pa.string())), texts if clean is None else pa.array(clean, pa.string())],
                names=schema.names,
            )

    return docs.mapInArrow(mark, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_words(spans) -> object:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def remove_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """The documents, columns as they were, without hit spans; those covered beyond most_coverage go whole.

    A column n_chars of whole numbers is set anew where the text changed.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = find_overlaps(own, items, window, "text")
    kept = found.filter(hit_words(F.col("spans")) <= F.col("n_words") * most_coverage)
    row = kept.withColumn("changed", F.size("spans") > 0)
    new = {text_col: F.when(F.col("changed"), F.col("clean_text")).otherwise(F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return row.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
