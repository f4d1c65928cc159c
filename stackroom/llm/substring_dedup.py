"""Passages that repeat across documents, by compact windows.

Tokens are five-word shingles. Under one of HASHES hash functions, a compact window (l, c, r) says
that every run within [l, r] that holds c has c's hash as its minimum: these are the nodes of the
Cartesian tree over the text's hashes, and only those at least as long as a passage matter (their
ancestors are among them, so the tree is built over them alone). Two passages of similarity s
share a window's minimum under a hash function with probability s; passages that are equal share
it under each. A passage that holds a minimum also holds at least half its own width to one side
of it, so it nearly always shares a minimum of that half as well; windows that share none, of
BESIDE functions on either side, only have a line in common.

Windows with equal hashes are paired with the one of the smallest document id, found by a partial
aggregation. Windows that are then not inside a verified passage get finer keys: their own
and a minimum beside it. Under finer keys of FEW windows at most all are paired, under larger ones
with the smallest document again. Windows that are still outside, and of which all keys on a
side are large, come last (few texts): with a key for every run of `length` words in them, so that
texts that share such a run meet the smallest document that has it, whatever the key's size,
and keys of two functions' minima at a time, for passages with edits. Windows that even then are
outside are compared exactly (_possible): each with every window of a smaller document under its
key, however many there are, block by block, until one has a passage with it. So equal passages are
always found; edited ones are where they share a window's minimum and one beside it, and don't meet
only texts that are inside a passage of the first round (those stand for themselves by its source).

A pair of documents' shared windows are joined as intervals: those on nearly the same diagonal
whose reaches overlap are one candidate passage. Candidates are verified on their words: the
largest stretches with a Jaccard similarity of `percent` or more over their shingles and `length`
words or more are passages.

Equal texts (equal word sequences, A-Z lower-cased) count as one text from the first aggregation
on and are reported as copies of the one with the smallest id.

Skew: one row for each long window, folded by key before any join; both sides of a join by key are
shuffled by themselves, so that Spark's skew join can split a hot key; a hot passage costs one
short candidate for each document that has it.

Defined cases: null and empty texts and texts of fewer than `length` words have no passages;
repetition within one document is not looked for; repeated rows of an id with one text are one
document, with different texts each text counts; rows with a null id are not looked at and are
kept; an empty table gives no rows. The input's other columns are kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm.arrow_text import SPACED_LOWER, _powers, mix, shingles, slices, tokenize
from stackroom.llm.components import apart
from stackroom.session import cut, delete, release, stored

WIDTH = 5
LENGTH = 50
HASHES = 3
PERCENT = 80
#: Regions sent for verification begin and end at multiples of this many words, so that equal requests meet.
GRID = 64
#: Diagonals this near to each other belong to one candidate passage (so many words added or dropped).
NEAR = 32
#: Hash functions of the minima beside a window's minimum.
BESIDE = 2
#: Windows left under a key that are all paired with each other; larger keys are split.
FEW = 8
#: Stretches that may be asked for by a broadcast (8 bytes each and an id); beyond that, texts are shuffled.
MOST_SENT = 300_000
#: Windows of a block; blocks of one key are compared with each other inside tasks.
BLOCK = 256
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C)]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values."""
    have, span = x, 1
    while span * 2 <= width:
        have = pick(have[:-span], have[span:])
        span *= 2
    return pick(have[: len(have) - (width - span)], have[width - span :]) if width > span else have


def windows(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of `width` hashes or more: c (in the flat array), how far each reaches to the left and to the right."""
    n = len(h)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = _slide(h, width, np.minimum)
    ends = np.repeat(rows[1:], np.diff(rows))[: len(low)]
    low = np.where(np.arange(len(low)) + width <= ends, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    centre = np.flatnonzero((_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h) & (h > 0))
    if not len(centre):
        return centre, centre, centre
    text = np.searchsorted(rows, centre, side="right") - 1
    first, last = rows[text].tolist(), (rows[text + 1] - 1).tolist()
    values, at, of = h[centre].tolist(), centre.tolist(), text.tolist()
    left, right = list(first), list(last)
    stack: list[int] = []
    for i, v in enumerate(values):
        if stack and of[stack[-1]] != of[i]:
            stack.clear()
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    lo, hi = centre - np.array(left), np.array(right) - centre
    keep = lo + hi + 1 >= width
    return centre[keep], lo[keep], hi[keep]


def _sequence(tok) -> np.ndarray:
    """A hash of each text's word sequence; 0 for a text without words."""
    n = len(tok.hash)
    place = np.arange(n) - tok.rows[:-1][tok.row_of()] if n else np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(tok.hash ^ mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))), out=sums[1:])
    return np.where(np.diff(tok.rows) > 0, mix(sums[tok.rows[1:]] - sums[tok.rows[:-1]]), np.uint64(0)).view(np.int64)


def windows_of(docs: DataFrame, length: int, hashes: int) -> DataFrame:
    """key (of hash function and hash), doc_id, f, place, beside and n_words of each compact window.

    place: where the window's minimum is, and how far the window reaches to the left and to the right
    of it, and the hash function (_unpacked). beside: the minima of half a passage's width to the
    right and to the left of it, under BESIDE functions each, in 16 bits (meaningless where a
    window doesn't reach so far). n_words: of the text, in one of its rows; null in the others. Only
    texts of `length` words or more have rows.
    """
    width, half = length - WIDTH + 1, _half(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), SPACED_LOWER)
            values, rows = shingles(tok, WIDTH, False)
            f, ids = _sequence(tok), b.column("doc_id").to_numpy(zero_copy_only=False)
            h = [mix(values ^ _SALTS[k]) for k in range(max(hashes, BESIDE))]
            lows = [_slide(x, half, np.minimum) for x in h[:BESIDE]] if len(values) >= half else []
            parts = []
            counts = np.diff(tok.rows)
            for k in range(hashes):
                c, lo, hi = windows(h[k], rows, width)
                text = np.searchsorted(rows, c, side="right") - 1
                place = (c - rows[text]) << 31 | np.minimum(lo, 0x3FFF) << 17 | np.minimum(hi, 0x3FFF) << 3 | k
                beside = np.zeros(len(c), np.uint64)
                for low in lows:
                    for at in (c + 1, c - half):
                        beside = beside << np.uint64(16) | mix(low[np.clip(at, 0, len(low) - 1)]) >> np.uint64(48)
                # under the first function, at a text's first window
                first = np.diff(text, prepend=-1) > 0 if k == 0 else np.zeros(len(c), bool)
                parts.append((mix(h[k][c] + _SALTS[k]).view(np.int64), ids[text], f[text], place, beside.view(np.int64), counts[text], ~first))
            *columns, others = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns[:-1]), pa.array(columns[-1], mask=others)], names=["key", "doc_id", "f", "place", "beside", "n_words"])

    return docs.mapInArrow(run, "key long, doc_id long, f long, place long, beside long, n_words long")


def _unpacked(place: str, c: str, reach: str) -> list[Column]:
    """c, and reach (left, right and hash function in 14, 14 and 3 bits)."""
    return [F.shiftright(place, 31).cast("int").alias(c), F.col(place).bitwiseAND(0x7FFFFFFF).cast("int").alias(reach)]


def _half(length: int) -> int:
    """Shingles on one side of a minimum that any passage with it has, on one side at least."""
    return (length - WIDTH + 2) // 2 - 1


def _candidates(length: int):
    """Joins a document pair's shared windows as intervals; a row for each candidate passage."""
    width = length - WIDTH + 1
    margin = length + WIDTH
    names = ["doc", "f", "other", "of", "a1", "a2", "b1", "b2", "d"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 5

    def join(shared: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        groups: list[dict] = []
        open_: dict[int, list[dict]] = {}  # those that may still grow, by diagonal in steps of NEAR + 1
        for n, (c, oc, reach, oreach) in enumerate(sorted(shared)):
            lo, hi = min(reach >> 17, oreach >> 17), min(reach >> 3 & 0x3FFF, oreach >> 3 & 0x3FFF)
            if lo + hi + 1 < width * 3 // 5:
                continue
            diagonal = oc - c
            near, step = None, diagonal // (NEAR + 1)
            for k in (step - 1, step, step + 1):
                if own := open_.get(k):
                    own[:] = [g for g in own if g["end"] + 2 * margin >= c]
                    for g in own:
                        if abs(g["d"] - diagonal) <= NEAR and c - min(lo, margin) <= g["end"] + margin and (near is None or g["n"] > near["n"]):
                            near = g
            if near is None:
                groups.append(near := {"a": c, "b": c, "oa": oc, "ob": oc, "d": diagonal, "d0": diagonal, "end": c})
                open_.setdefault(step, []).append(near)
            elif (was := near["d"] // (NEAR + 1)) != step:
                open_[was].remove(near)
                open_.setdefault(step, []).append(near)
            near["b"], near["d"], near["end"], near["n"] = c, diagonal, max(near["end"], c + min(hi, margin)), n
            near["oa"], near["ob"] = min(near["oa"], oc), max(near["ob"], oc)
        for g in groups:
            yield max(g["a"] - margin, 0) // GRID * GRID, -(-(g["b"] + margin) // GRID) * GRID, max(g["oa"] - margin, 0) // GRID * GRID, -(-(g["ob"] + margin) // GRID) * GRID, g["d0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = b.column("shared")
            ends, flat = shared.offsets.to_numpy(), shared.values
            c, oc, reach, oreach = (flat.field(k).to_numpy() for k in ("c", "oc", "reach", "oreach"))
            out = []
            for i, own in enumerate(zip(*(b.column(k).to_pylist() for k in names[:4]), strict=True)):
                here = slice(ends[i], ends[i + 1])
                out += [(*own, *x) for x in join(list(zip(*(v[here].tolist() for v in (c, oc, reach, oreach)), strict=True)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return run, "doc long, f long, other long, of long, a1 int, a2 int, b1 int, b2 int, d int"


def _regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The 32-bit word hashes of the wanted stretches (doc_id, s, e) of texts."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("asked"))
    rows = docs.select("doc_id", "text").join(F.broadcast(asked) if wanted.count() <= MOST_SENT else asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), SPACED_LOWER)
            words = (tok.hash >> np.uint64(32)).astype(np.uint32)
            f = _sequence(tok).tolist()
            out: list[tuple] = []
            for i, (doc, asked) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                first, last = int(tok.rows[i]), int(tok.rows[i + 1])
                out += [(doc, f[i], x["s"], x["e"], words[first + x["s"] : min(first + x["e"], last)].tobytes()) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "f", "s", "e", "words"])

    return rows.mapInArrow(run, "doc_id long, f long, s int, e int, words binary").dropDuplicates(["doc_id", "f", "s", "e"])


def _grams(words: np.ndarray) -> np.ndarray:
    n = max(len(words) - WIDTH + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def _grams_of(words: pd.Series) -> list[np.ndarray]:
    """The shingles of each run of words, hashed all at once."""
    sizes = np.array([len(x) // 4 for x in words], np.int64)
    ends = np.cumsum(sizes)
    grams = _grams(np.frombuffer(b"".join(words), np.uint32))
    return [grams[s : max(e - WIDTH + 1, s)] for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def verify(a: np.ndarray, b: np.ndarray, diagonal: int, length: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages of words a and b that are similar enough: (start, end) in a, (start, end) in b, similarity.

    Shared shingles are matched to their nearest place on the diagonal; matches stand in stretches,
    which are cut at their widest gap until similar enough or too short.
    """
    return _stretches(_grams(a), _grams(b), diagonal, length, percent)


def _stretches(x: np.ndarray, y: np.ndarray, diagonal: int, length: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """verify() of shingles x and y."""
    width = length - WIDTH + 1
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    found = np.flatnonzero(hi > lo)
    if len(found) < width * percent // 100 // 2:
        return []
    first, last = lo[found], hi[found] - 1
    place = order[first]
    # y's shingles by number, x's by the same (those that y hasn't by the last), and where x had a shingle before
    ranks = np.cumsum(np.append(0, y[order][1:] != y[order][:-1]))
    numbers, codes = np.zeros(len(y), np.int64), np.full(len(x), ranks[-1] + 1)
    numbers[order], codes[found] = ranks, ranks[first]
    before = _before(x)
    if (last > first).any():
        # among equal shingles, which stand in order, the places before and after the diagonal
        big = len(y) + 1
        wish = np.clip(found + diagonal, 0, len(y))
        after = np.searchsorted(ranks * big + order, ranks[first] * big + wish)
        nearer, after = order[np.clip(after - 1, first, last)], order[np.clip(after, first, last)]
        place = np.where(np.abs(after - (found + diagonal)) < np.abs(nearer - (found + diagonal)), after, nearer)
    out = []
    work = [(0, len(found))]
    while work:
        s, e = work.pop()
        p, q = found[s:e], place[s:e]
        if e <= s or p[-1] - p[0] + 1 < width * percent // 100:
            continue
        gaps = np.maximum(np.diff(p), np.abs(np.diff(q)))
        q1, q2 = int(q.min()), int(q.max())
        there = np.zeros(ranks[-1] + 2, bool)
        there[numbers[q1 : q2 + 1]] = True
        fresh = before[p[0] : p[-1] + 1] < p[0]
        both = int(np.count_nonzero(fresh & there[codes[p[0] : p[-1] + 1]]))
        either = int(np.count_nonzero(fresh)) + int(np.count_nonzero(there)) - both
        similar = 100 * both >= percent * either
        if similar and (not len(gaps) or gaps.max() <= width):
            if min(p[-1] - p[0], q2 - q1) + WIDTH >= length:
                out.append((int(p[0]), int(p[-1]) + WIDTH, q1, q2 + WIDTH, both / either))
            continue
        if len(gaps) and gaps.max() > 1:
            k = s + int(gaps.argmax()) + 1
            work += [(s, k), (k, e)]
    return sorted(out)


def _before(x: np.ndarray) -> np.ndarray:
    """Where each value was last before; -1 for nowhere."""
    by = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[by][1:] == x[by][:-1])
    before = np.full(len(x), -1)
    before[by[again + 1]] = by[again]
    return before


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, percent: int = PERCENT, hashes: int = HASHES) -> DataFrame:
    """A row for each repeated passage: where it stands in a document, and where in one with a smaller id.

    Copies of a whole text are rows as well, from the first word to the last.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    rows = stored(windows_of(own, length, hashes))
    texts = cut(rows.filter("n_words is not null").select("doc_id", "f", "n_words"))
    first = texts.groupBy("f", "n_words").agg(F.min("doc_id").alias("source_id"))
    copies = texts.select("doc_id", "n_words", apart("f")).join(first.select(apart("f"), "n_words", "source_id"), ["k", "n_words"]).filter("doc_id <> source_id").distinct()
    whole = copies.select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"), "source_id", F.lit(0).alias("source_start"), F.col("n_words").cast("int").alias("source_end"), F.lit(1.0).alias("similarity"))

    led = stored(_first_led(rows.drop("n_words"), length))
    for folder in {x.rpartition("/")[0] for x in rows.inputFiles()}:  # all that is read of it is written
        delete(docs.sparkSession, folder)
    first_round = cut(_passages(own, led.filter("near"), length, percent))
    release(docs.sparkSession)
    # what isn't part of a passage yet: all with all under finer keys of few windows, with their leader under larger ones
    each = F.col("n") <= FEW
    finer = cut(_several(_beside(_outside(led.select("key", "doc_id", "f", "c", "reach", "beside"), first_round), length)))
    large = finer.filter(~each)
    second_round = cut(_passages(own, _all_pairs(finer.filter(each)).unionByName(_led(large, large)), length, percent))
    # windows of which all keys on a side are large
    release(docs.sparkSession)
    many = _outside(large, second_round).groupBy("top", "f", "c", "reach").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter(F.col("n") >= BESIDE).withColumnRenamed("top", "key")
    finest = cut(_several(_runs_of(own, many, length, hashes)))
    leaders = finest.filter(~each)
    third_round = cut(_passages(own, _all_pairs(finest.filter(each)).unionByName(_led(leaders, leaders)), length, percent))
    # what is still outside under a key of more than FEW: compared with every text under its key
    release(docs.sparkSession)
    open_ = cut(_outside(_outside(large, second_round), third_round))
    passages = first_round.union(second_round).union(third_round).union(_passages(own, _possible(own, large, open_, length, percent), length, percent))

    mine = F.col("doc") > F.col("other")
    pick = lambda x, y, name: F.when(mine, F.col(x)).otherwise(F.col(y)).alias(name)
    return passages.select(
        pick("doc", "other", "doc_id"), pick("s", "os", "start_word"), pick("e", "oe", "end_word"), pick("other", "doc", "source_id"), pick("os", "s", "source_start"), pick("oe", "e", "source_end"), "similarity"
    ).distinct().unionByName(whole)


def _outside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The windows whose minimum isn't inside a verified passage, by the documents of larger ids."""
    ahead = F.col("doc") > F.col("other")
    own, span = F.when(ahead, F.col("f")).otherwise(F.col("of")), lambda s, e: F.struct(F.col(s).alias("s"), F.col(e).alias("e"))
    done = found.select(own.alias("f"), F.when(ahead, span("s", "e")).otherwise(span("os", "oe")).alias("x")).groupBy("f").agg(F.collect_set("x").alias("spans"))
    inside = F.exists("spans", lambda x: (x["s"] <= F.col("c")) & (F.col("c") + WIDTH <= x["e"]))
    return rows.join(done, "f", "left").filter(F.col("spans").isNull() | ~inside).drop("spans")


def _several(rows: DataFrame) -> DataFrame:
    """Windows under keys of more than one text, with their key's number of windows n."""
    keys = rows.groupBy("key").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.count("*").alias("n")).filter("low <> high").select(apart("key"), "n")
    rest = [c for c in rows.columns if c != "key"]
    return rows.select(apart("key"), *rest).join(keys, "k").select(apart("k", "key"), *rest, "n")


def _first_led(rows: DataFrame, length: int) -> DataFrame:
    """As _led for the rows of windows_of, with beside and near: whether a minimum beside is the leader's as well.

    All of a leader's values come from one row: ties are settled alike for each of them.
    """
    first = lambda c: F.min_by(c, "doc_id")
    keys = rows.groupBy("key").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.min("doc_id").alias("other"), first("f").alias("of"), first("place").alias("oplace"), first("beside").alias("obeside"))
    keys = stored(keys.filter("low <> high").select(apart("key"), "other", "of", "oplace", "obeside"))
    release(rows.sparkSession)
    led = rows.select(apart("key"), "doc_id", "f", "place", "beside").join(keys, "k").filter("f <> of")
    led = led.select(apart("k", "key"), "doc_id", "f", *_unpacked("place", "c", "reach"), "beside", "other", "of", *_unpacked("oplace", "oc", "oreach"), F.col("beside").bitwiseXOR(F.col("obeside")).alias("differ"))
    near = [F.shiftright("differ", s).bitwiseAND(0xFFFF).eqNullSafe(0) & a & b for j in range(BESIDE) for s, a, b in zip(_shifts(j), _reached("reach", length), _reached("oreach", length), strict=True)]
    return led.withColumn("near", reduce(Column.__or__, near)).drop("differ")


def _shifts(j: int) -> tuple[int, int]:
    """Where the minima to the right and to the left are in beside, under the j-th function."""
    return 16 * (2 * (BESIDE - 1 - j) + 1), 16 * (2 * (BESIDE - 1 - j))


def _reached(reach: str, length: int) -> tuple[Column, Column]:
    """Whether a window reaches half a passage's width to the right, and to the left."""
    return F.col(reach).bitwiseAND(0x1FFFF) >= _half(length) * 8, F.shiftright(reach, 17) >= _half(length)


def _led(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows of rows with the one of the smallest document under their key in keys, where that is another text's."""
    names = ["doc_id", "f", "c", "reach"]
    leaders = keys.groupBy("key").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.min(F.struct(*names)).alias("o")).filter("low <> high")
    leaders = leaders.select(apart("key"), F.col("o.doc_id").alias("other"), F.col("o.f").alias("of"), F.col("o.c").alias("oc"), F.col("o.reach").alias("oreach"))
    return rows.select(apart("key"), *names).join(leaders, "k").filter("f <> of").select(apart("k", "key"), *names, "other", "of", "oc", "oreach")


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Windows with all of smaller documents under their key."""
    others = rows.select("key", F.col("doc_id").alias("other"), F.col("f").alias("of"), F.col("c").alias("oc"), F.col("reach").alias("oreach"))
    return rows.select("key", "doc_id", "f", "c", "reach").join(others, "key").filter("f <> of and doc_id > other")


def _beside(rows: DataFrame, length: int) -> DataFrame:
    """Windows under finer keys: one for each side that a window reaches half a passage's width to, and each function of the minima there.

    top tells the key and the side that a row comes from, own the key.
    """
    bits = lambda j, side: F.shiftright("beside", _shifts(j)[side]).bitwiseAND(0xFFFF)
    finer = lambda side: F.array(*[F.struct(F.xxhash64("key", F.lit(side)).alias("top"), F.xxhash64("key", F.lit(side * BESIDE + j), bits(j, side)).alias("key")) for j in range(BESIDE)])
    keys = F.concat(*[F.when(ok, finer(side)).otherwise(F.array().cast("array<struct<top:bigint,key:bigint>>")) for side, ok in enumerate(_reached("reach", length))])
    return rows.select(F.col("key").alias("own"), "doc_id", "f", "c", "reach", F.explode(keys).alias("x")).select("x.key", "doc_id", "f", "c", "reach", "x.top", "own")


def _runs_of(docs: DataFrame, many: DataFrame, length: int, hashes: int) -> DataFrame:
    """Windows under the finest keys: the minima of two functions at a time beside a minimum, and a row for each run of `length` words in a window.

    A run's row has no hash function of its own (7) and reaches as far as the run.
    """
    width = length - WIDTH + 1
    half = _half(length)
    one = many.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.collect_set(F.struct("key", "c", "reach")).alias("asked"))
    asked = cut(one.groupBy("doc_id").agg(F.collect_list(F.struct("f", "asked")).alias("asked")))
    rows = docs.select("doc_id", "text").join(F.broadcast(asked) if asked.count() <= MOST_SENT // 10 else asked, "doc_id")
    names = ["key", "doc_id", "f", "c", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), SPACED_LOWER)
            values, rows = shingles(tok, WIDTH, False)
            f, ids = _sequence(tok), b.column("doc_id").to_numpy(zero_copy_only=False)
            own = [(i, x["key"], x["c"], x["reach"]) for i, texts in enumerate(b.column("asked").to_pylist()) for t in texts if t["f"] == f[i] for x in t["asked"]]
            if not own:
                continue
            text, key, c, reach = (np.array(x, np.int64) for x in zip(*own, strict=True))
            at, lo, hi = rows[text] + c, reach >> 17, reach >> 3 & 0x3FFF
            # every start from which a passage's width stays in a window and holds its minimum
            edge = np.zeros(len(values) + 1, np.int64)
            np.add.at(edge, at - np.minimum(lo, width - 1), 1)
            np.add.at(edge, at + np.minimum(hi, width - 1) - width + 2, -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            of = np.searchsorted(rows, start, side="right") - 1
            parts = [(_runs(values, start, width), of, start - rows[of], np.full(len(start), (width - 1) << 3 | 7))]
            # beside a minimum: where a window reaches so far, the minima there
            right, left = np.flatnonzero(hi >= half), np.flatnonzero(lo >= half)
            side = np.concatenate([right, left])
            begin = np.concatenate([at[right] + 1, at[left] - half])
            base = mix(key[side].view(np.uint64) + np.repeat(np.array([1, 2], np.uint64), [len(right), len(left)]))
            beside = [mix(_slide(mix(values ^ _SALTS[k]), half, np.minimum)[begin] + _SALTS[k]) for k in range(hashes)]
            parts += [(mix(mix(base ^ beside[j]) + beside[k]).view(np.int64), text[side], c[side], reach[side]) for j in range(hashes) for k in range(j + 1, hashes)]
            keys, of, c, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[of]), pa.array(f[of]), pa.array(c.astype(np.int32)), pa.array(reach.astype(np.int32))], names=names)

    return rows.mapInArrow(run, "key long, doc_id long, f long, c int, reach int")


def _possible(docs: DataFrame, large: DataFrame, open_: DataFrame, length: int, percent: int) -> DataFrame:
    """Open windows with a window of a smaller document's other text under their key that a passage around their minimum is shared with, where there is one.

    A passage begins and ends with shared shingles and has `percent` of its shingles from the other
    text, so an open window only asks if shingles that another text has under the key allow one. It
    is compared with every window under its key, those inside a passage and the leaders as well; of
    those with the same shingles around their minimum, with the smallest document's. Blocks of
    windows meet, not windows: only what is verified leaves the task.
    """
    window = lambda rows: rows.groupBy("own", "f", "c", "reach").agg(F.min("doc_id").alias("doc_id"))
    near = stored(_nearby(docs, window(large.join(open_.select("key").distinct(), "key", "left_semi")), length).withColumn("w", F.xxhash64("own", "f", "c")))
    word = F.xxhash64("own", "x").alias("y")
    rows = near.select("own", "f", F.explode(F.array_distinct("nearby")).alias("x")).select(word, "f")
    shared = rows.groupBy("y").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("low <> high").select(apart("y"))
    asking = near.join(window(open_).select(F.xxhash64("own", "f", "c").alias("w")), "w", "left_semi")
    known = asking.select("w", "own", F.explode(F.array_distinct("nearby")).alias("x")).select("w", "x", word).select("w", "x", apart("y")).join(shared, "k").groupBy("w").agg(F.collect_set("x").alias("xs"))
    width = length - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = []
            (ends, nearby), (knows, xs) = ((x.offsets.to_numpy().tolist(), x.values.to_numpy()) for x in (b.column("nearby"), b.column("xs")))
            for i, at in enumerate(b.column("at").to_pylist()):
                own, known = nearby[ends[i] : ends[i + 1]], np.sort(xs[knows[i] : knows[i + 1]])
                # a run of shared ones is enough; else any stretch
                other = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] != own)
                k = int(np.searchsorted(other, at))
                low, high = int(other[k - 1]) if k else -1, int(other[k]) if k < len(other) else len(own)
                fits.append(high > at and high - low > width or len(_ends(own, at, known, np.ones(len(known), np.int64), width, percent)) > 0)
            yield pa.RecordBatch.from_arrays([b.column("w").filter(pa.array(fits, pa.bool_()))], names=["w"])

    asked = cut(asking.join(known, "w").select("w", "at", "nearby", "xs").mapInArrow(run, "w long").distinct())
    askers = asking.join(asked, "w", "left_semi")
    within = near.join(askers.select("own").distinct(), "own", "left_semi").select("own", "doc_id", "f", "w", F.xxhash64("at", "nearby").alias("alike"))
    first = within.groupBy("own", "alike").agg(F.min(F.struct("doc_id", "f", "w")).alias("o")).select(F.col("o.w").alias("w"))
    sides = [_blocks(x).select(apart("own"), F.col("rows").alias(name)) for x, name in ((askers, "mine"), (near.join(first, "w", "left_semi"), "theirs"))]
    names = ["doc_id", "f", "c", "reach", "other", "of", "oc", "oreach"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                mine, theirs = (_Block(b.column(k).slice(i, 1).flatten()) for k in ("mine", "theirs"))
                w, v = _witnesses(mine, theirs, length, percent)
                yield pa.RecordBatch.from_arrays([side.rows.field(k).take(pa.array(at, pa.int64())) for side, at in ((mine, w), (theirs, v)) for k in names[:4]], names=names)

    return sides[0].join(sides[1], "k").select("mine", "theirs").mapInArrow(meet, "doc_id long, f long, c int, reach int, other long, of long, oc int, oreach int")


def _blocks(rows: DataFrame) -> DataFrame:
    """own, rows: the windows of each key in blocks of about BLOCK, dealt by what they are."""
    sizes = rows.groupBy("own").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).select(apart("own"), "blocks")
    columns = ["doc_id", "f", "c", "reach", "at", "nearby"]
    dealt = rows.select(apart("own"), "w", *columns).join(sizes, "k").select(apart("k", "own"), F.expr("pmod(w, blocks)").alias("block"), *columns)
    return dealt.groupBy("own", "block").agg(F.collect_set(F.struct(*columns)).alias("rows"))


class _Block:
    """A block's windows as arrays; those of one window's shingles are flat[ends[i] : ends[i + 1]]."""

    def __init__(self, rows: pa.StructArray):
        self.rows = rows
        self.doc, self.f, self.at = (rows.field(k).to_numpy() for k in ("doc_id", "f", "at"))
        nearby = rows.field("nearby")
        self.ends = np.concatenate([[0], np.cumsum(nearby.value_lengths().to_numpy())])
        self.flat = nearby.flatten().to_numpy()

    def __len__(self) -> int:
        return len(self.doc)


def _witnesses(mine: _Block, theirs: _Block, length: int, percent: int) -> tuple[list[int], list[int]]:
    """Places of windows in mine and of those of smaller documents in theirs that they have a passage with; no more for a window once one holds its minimum."""
    width = length - WIDTH + 1
    every, codes = np.unique(mine.flat, return_inverse=True)
    at = np.minimum(np.searchsorted(every, theirs.flat), len(every) - 1)
    ours = every[at] == theirs.flat
    # a passage spans `width` shingles of theirs as well, from a shared one to a shared one
    spans = np.flatnonzero(_span(ours, theirs.ends) >= width)
    sizes = np.diff(theirs.ends)[spans]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.repeat(theirs.ends[spans] - ends[:-1], sizes) + np.arange(ends[-1])
    at, ours, of, doc, f = at[flat], ours[flat], np.repeat(np.arange(len(spans)), sizes), theirs.doc[spans], theirs.f[spans]
    code = np.where(ours, at, len(every))
    # where each of our shingles is first in each of their windows, -1 for nowhere; and what stands there more than once
    place = np.full((len(spans), len(every)), -1, np.int16)
    place[of[ours][::-1], at[ours][::-1]] = (np.arange(len(of)) - ends[of])[ours][::-1]
    once = np.array([len(np.unique(theirs.flat[theirs.ends[j] : theirs.ends[j + 1]])) == n for j, n in zip(spans.tolist(), sizes.tolist(), strict=True)], bool)
    w: list[int] = []
    v: list[int] = []
    for i in range(len(mine)):
        own, centre = codes[mine.ends[i] : mine.ends[i + 1]], int(mine.at[i])
        which = np.flatnonzero((doc < mine.doc[i]) & (f != mine.f[i]))
        if len(which):
            among = np.zeros(len(every) + 1, bool)
            among[own] = True
            which = which[_span(among[code], ends)[which] >= width]
        if not len(which):
            continue
        where = place[which][:, own]
        has = where >= 0
        first, last = has.argmax(1), len(own) - 1 - has[:, ::-1].argmax(1)
        some = (first <= centre) & (last >= centre) & (last - first + 1 >= width)
        which, where, has = which[some], where[some], has[some]
        if not len(which):
            continue
        if len(np.unique(own)) == len(own):
            keep = np.flatnonzero(_fits(has, centre, width, percent))
            keep = keep[~once[which[keep]] | _close(where[keep], centre, width, percent)]
        else:
            keep = np.flatnonzero(_fits_repeated(own, has, centre, width, percent))
        x = mine.flat[mine.ends[i] : mine.ends[i + 1]]
        for k in keep[np.argsort(-has[keep].sum(1), kind="stable")].tolist():
            j = int(spans[which[k]])
            found = _stretches(x, theirs.flat[theirs.ends[j] : theirs.ends[j + 1]], int(theirs.at[j]) - centre, length, percent)
            if found:
                w.append(i)
                v.append(j)
            if any(s <= centre and centre + WIDTH <= e for s, e, *_ in found):
                break
    return w, v


def _span(shared: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each window shared[ends[i] : ends[i + 1]], which has a shingle at least: how many there are from the first shared one to the last."""
    if len(ends) < 2:
        return np.zeros(0, np.int64)
    place = np.arange(len(shared))
    last = np.maximum.reduceat(np.where(shared, place, -1), ends[:-1])
    return np.where(last < 0, 0, last - np.minimum.reduceat(np.where(shared, place, len(shared)), ends[:-1]) + 1)


def _fits(has: np.ndarray, at: int, width: int, percent: int) -> np.ndarray:
    """For each row of has (which shingles another window has): whether a stretch around a place, with both its ends, has so many of its shingles from there."""
    n = has.shape[1]
    if n < width:
        return np.zeros(len(has), bool)
    score = np.zeros((len(has), n + 1), np.int32)
    np.cumsum(np.where(has, 100 - percent, -percent), axis=1, out=score[:, 1:])
    best = np.maximum.accumulate(np.where(has, score[:, 1:], -(1 << 30))[:, ::-1], axis=1)[:, ::-1]
    starts = np.arange(min(at, n - width) + 1)
    return (has[:, starts] & (best[:, np.maximum(starts + width - 1, at)] >= score[:, starts])).any(1)


def _fits_repeated(own: np.ndarray, has: np.ndarray, at: int, width: int, percent: int) -> np.ndarray:
    """As _fits for shingles of which some are there again: in a stretch each counts once. Rows alike are looked at once."""
    n = len(own)
    if n < width:
        return np.zeros(len(has), bool)
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order][1:] == own[order][:-1])
    before = np.full(n, -1)
    before[order[again + 1]] = order[again]
    starts = np.arange(min(at, n - width) + 1)
    fresh = (before[None, :] < starts[:, None]) & (np.arange(n)[None, :] >= starts[:, None])
    wide = np.arange(n)[None, :] >= np.maximum(starts + width - 1, at)[:, None]
    due = np.where(wide, percent * np.cumsum(fresh, axis=1), 1 << 30)
    alike, which = np.unique(np.packbits(has, axis=1), axis=0, return_inverse=True)
    rows = np.unpackbits(alike, axis=1, count=n).astype(bool)
    some = np.flatnonzero(rows[:, starts].any(1) & rows[:, max(at, width - 1) :].any(1))
    fits = np.zeros(len(rows), bool)
    for k in some.tolist():
        row = rows[k]
        a, b = np.flatnonzero(row[starts]), np.flatnonzero(row)
        b = b[b >= at]
        if b[-1] - a[0] + 1 >= width:
            fits[k] = (100 * np.cumsum(fresh[a] & row, axis=1, dtype=np.int32)[:, b] >= due[a][:, b]).any()
    return fits[which.reshape(-1)]


def _close(where: np.ndarray, at: int, width: int, percent: int) -> np.ndarray:
    """As _fits, where no shingle is twice on either side and where says its place on the other: whether the other's stretch isn't too long either."""
    out = np.zeros(len(where), bool)
    for k, row in enumerate(where):
        found = np.flatnonzero(row >= 0)
        a, b = found[found <= at], found[found >= at]
        n = np.arange(len(found))
        both = n[len(found) - len(b) :][None, :] - n[: len(a)][:, None] + 1
        here, there = b[None, :] - a[:, None] + 1, np.abs(row[b].astype(int)[None, :] - row[a].astype(int)[:, None]) + 1
        out[k] = ((here >= width) & (100 * both >= percent * (here + np.maximum(there, both) - both))).any()
    return out


def _nearby(docs: DataFrame, around: DataFrame, length: int) -> DataFrame:
    """The windows with the shingles around their minimum, as far as a candidate reaches, hashed to 32 bits with their key, and where the minimum is among them."""
    reach = length + WIDTH
    one = around.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.collect_list(F.struct("own", "c", "reach")).alias("asked"))
    asked = one.groupBy("doc_id").agg(F.collect_list(F.struct("f", "asked")).alias("asked"))
    names = ["own", "doc_id", "f", "c", "reach", "at", "nearby"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), SPACED_LOWER)
            values, rows = shingles(tok, WIDTH, False)
            f = _sequence(tok).tolist()
            out: list[tuple] = []
            for i, (doc, texts) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                own = values[rows[i] : rows[i + 1]]
                for x in (x for t in texts if t["f"] == f[i] for x in t["asked"]):
                    first = max(x["c"] - reach, 0)
                    keyed = (mix(own[first : x["c"] + reach + 1] ^ np.int64(x["own"]).view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out.append((x["own"], doc, f[i], x["c"], x["reach"], x["c"] - first, keyed))
                if len(out) > 2000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").join(asked, "doc_id").mapInArrow(run, "own long, doc_id long, f long, c int, reach int, at int, nearby array<int>")


def _ends(shingles: np.ndarray, at: int, known: np.ndarray, counts: np.ndarray, width: int, percent: int) -> np.ndarray:
    """The rarer end of each stretch around a place that could be a passage, where only known shingles can be shared."""
    order = np.argsort(known)
    place = np.minimum(np.searchsorted(known[order], shingles), len(known) - 1)
    n = np.where(known[order][place] == shingles, counts[order][place], 0)
    left, right = np.flatnonzero(n[: at + 1]), at + np.flatnonzero(n[at:])
    if not len(left) or not len(right) or right[-1] - left[0] + 1 < width:
        return np.zeros(0, np.int64)
    # where a shingle was last: in a stretch each counts once
    before = np.full(len(shingles), -1)
    by = np.argsort(shingles, kind="stable")
    again = np.flatnonzero(shingles[by][1:] == shingles[by][:-1])
    before[by[again + 1]] = by[again]
    fresh = (before[None, :] < left[:, None]) & (np.arange(len(shingles))[None, :] >= left[:, None])
    every, shared = np.cumsum(fresh, axis=1)[:, right], np.cumsum(fresh & (n > 0)[None, :], axis=1)[:, right]
    fits = (right[None, :] - left[:, None] + 1 >= width) & (100 * shared >= percent * every)
    a, b = left[:, None], right[None, :]
    rarer = np.where((n[a] < n[b]) | (n[a] == n[b]) & (shingles[a] < shingles[b]), a, b)[fits]
    return np.unique(shingles[rarer])


def _runs(values: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` values from each start."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[start + width] - sums[start]) * inverse[start]).view(np.int64)


def _passages(docs: DataFrame, led: DataFrame, length: int, percent: int) -> DataFrame:
    """Verified passages (doc, f, s, e, other, of, os, oe, similarity) of windows paired with their key's leader."""
    shared = led.groupBy("f", "of").agg(F.min("doc_id").alias("doc"), F.min("other").alias("other"), F.collect_set(F.struct("c", "reach", "oc", "oreach")).alias("shared"))
    run, schema = _candidates(length)
    found = cut(shared.mapInArrow(run, schema))
    release(docs.sparkSession)  # what led's rows came from
    wanted = cut(found.select(F.col("doc").alias("doc_id"), F.col("a1").alias("s"), F.col("a2").alias("e")).union(found.select("other", "b1", "b2")).distinct())
    regions = cut(_regions(docs, wanted))
    release(docs.sparkSession)
    sides = found.join(regions.toDF("doc", "f", "a1", "a2", "words"), ["doc", "f", "a1", "a2"]).join(regions.toDF("other", "of", "b1", "b2", "other_words"), ["other", "of", "b1", "b2"])
    names = ["doc", "f", "s", "e", "other", "of", "os", "oe", "similarity"]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            x, y = (_grams_of(pdf[c]) for c in ("words", "other_words"))
            for i, (doc, f, other, of, a1, b1, d) in enumerate(zip(*(pdf[c].tolist() for c in ("doc", "f", "other", "of", "a1", "b1", "d")), strict=True)):
                for s, e, os_, oe, sim in _stretches(x[i], y[i], d - b1 + a1, length, percent):
                    out.append((doc, f, s + a1, e + a1, other, of, os_ + b1, oe + b1, sim))
            yield pd.DataFrame(out, columns=names)

    return sides.select("doc", "f", "other", "of", "a1", "b1", "d", "words", "other_words").mapInPandas(check, "doc long, f long, s int, e int, other long, of long, os int, oe int, similarity double")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """The documents, columns as they were, without passages that stand in a document of a smaller id.

    Copies of a whole text go, as do documents of which no word is left. A column n_chars of whole
    numbers is set anew where the text changed.
    """
    found = cut(find_repeats(docs, id_col, text_col, length, percent))
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("_spans"))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(spans) if found.count() <= MOST_SENT else spans, "_id", "left")
    plain = rows.filter("_spans is null").select("row.*")
    changed = rows.filter("_spans is not null").select("row", "text", "_spans")
    schema = changed.select("row").schema.add("clean", "string")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok = tokenize(b.column("text"), SPACED_LOWER)
            clean: list[str | None] = []
            for i, spans in enumerate(b.column("_spans").to_pylist()):
                raw = tok.data[tok.offsets[i] : tok.offsets[i + 1]].tobytes()
                begin, end = tok.begin[tok.rows[i] : tok.rows[i + 1]] - tok.offsets[i], tok.end[tok.rows[i] : tok.rows[i + 1]] - tok.offsets[i]
                at, pieces = 0, []
                for s, e in sorted((x["start_word"], x["end_word"]) for x in spans):
                    s, e = int(begin[s]), int(end[min(e, len(end)) - 1])
                    if s > at or not pieces:
                        pieces.append(raw[at : max(s, at)])
                    at = max(at, e)
                left = b"".join([*pieces, raw[at:]])
                clean.append(left.decode() if left.split() else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(clean, pa.string())], names=["row", "clean"])

    made = changed.mapInArrow(cut_out, schema).filter("clean is not null")
    new = {text_col: F.col("clean")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(made.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names]))
