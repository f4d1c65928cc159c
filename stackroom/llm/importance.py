"""Target-distribution importance resampling: draw documents that look like a target's.

Features are runs of words, hashed (CRC-32) into buckets. A bucket's gain is the logarithm of its
share in the target over its share in the corpus, smoothed, in thousandths, rounded down; a document's
weight is the sum of its features' gains. Gumbel noise of its id is added, and the highest scores
among documents with enough words are a sample without replacement by weight.

Counting and scoring each read the texts once: a task counts into one array of buckets, and
scores by an array of gains (both as long as the number of buckets, a parameter). Words' checksums are
worked out for a whole slice of texts at once.

The draw merges sorted runs. Quantiles of the sort key cut the order into ranges of about RANGE_ROWS rows, and the
exact count of each range says how many ranges hold the draw, and which rank each begins
with. Every partition sorts its eligible rows of those ranges (a run) and packs them into blocks of
BLOCK rows at most that stay within a range. A task for each range merges the runs' blocks by a
tournament tree whose leaves are runs: blocks come in the order of their first row, so a run has one
block in memory, and a block is only taken up when its first row may be the next. Once the exact
number is drawn, the rest of the range goes through as it is; later ranges are not merged at all. No
file but the shared tables is written, so a lost executor's task just runs again.

Defined cases: null, empty and wordless texts have no features, weight 0, and aren't eligible; a null
id counts as no digits and comes after the others among ties; rows of one id are rows of their own,
and of equal rows any comes first, but each has its own rank; without a target all buckets count by the
corpus alone; an empty table gives none. Only id and text are looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm.arrow_text import ALNUM_LOWER, slices, tokenize
from stackroom.session import stored

BUCKETS, LONGEST = 10_000, 1
#: Words that a document must have to be drawn, documents drawn of a hundred, and the noise's seed.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Rows of a range, ranges at least, and rows of a block.
RANGE_ROWS, LEAST_RANGES, BLOCK = 1 << 18, 16, 1024
#: Words of more bytes are hashed one by one.
_LONG = 48


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each data[begin:end], each continued from a checksum before it, if any."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    at, size = begin[order], size[order]
    reg = np.zeros(len(order), np.uint32) if before is None else before[order].astype(np.uint32)
    long_ = int(np.searchsorted(-size, -_LONG, "left"))
    for i in range(long_):
        reg[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(reg[i]))
    reg[long_:] ^= np.uint32(0xFFFFFFFF)
    for k in range(int(size[long_]) if long_ < len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # words that have a byte here
        here = reg[long_:m]
        reg[long_:m] = _TABLE[(here ^ data[at[long_:m] + k]) & np.uint32(0xFF)] ^ (here >> np.uint32(8))
    reg[long_:] ^= np.uint32(0xFFFFFFFF)
    out = np.empty_like(reg)
    out[order] = reg
    return out


def features(col: pa.Array, longest: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each run length the features' buckets and texts' first feature (with the count at the end); and texts' first word."""
    tok = tokenize(col, ALNUM_LOWER)
    data = ALNUM_LOWER[tok.data]
    blank = np.full(1, 32, np.uint8)
    ends = np.repeat(tok.rows[1:], np.diff(tok.rows))
    out = []
    first, sums = np.arange(len(tok.begin)), checksums(data, tok.begin, tok.end)
    for n in range(1, longest + 1):
        if n > 1:  # one more word, for the runs that don't end with their text
            inside = first + n - 1 < ends[first]
            first, sums = first[inside], sums[inside]
            zero = np.zeros(len(first), np.int64)
            sums = checksums(blank, zero, zero + 1, sums)
            sums = checksums(data, tok.begin[first + n - 1], tok.end[first + n - 1], sums)
        out.append(((sums % np.uint32(buckets)).astype(np.int64), np.searchsorted(first, tok.rows)))
    return out, tok.rows


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into it, where any does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            for found, _ in features(b.column("text"), longest, buckets)[0]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, from its counts; so many numbers as there are buckets come here."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    out = np.empty(buckets, np.int64)
    for b in range(buckets):
        ratio = ((target.get(b, 0) + 1.0) * (s_all + buckets)) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets))
        out[b] = math.floor(1000 * math.log(ratio))
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches, "text"):
            found, rows = features(b.column("text"), longest, len(own))
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for buckets, at in found:
                sums = np.concatenate([[0], np.cumsum(own[buckets])])
                n += np.diff(at)
                weight += sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


class Tournament:
    """A tree of matches between runs: the best key of all leaves is at the root; a leaf's change replays its path only."""

    LAST = (1 << 62,)  #: the key of a leaf without rows; keys begin with numbers below

    def __init__(self):
        self.size = 1
        self.keys = [self.LAST]
        self.winner = [0, 0]  # by node: 1 is the root, leaf i stands at size + i

    def put(self, leaf: int, key: tuple) -> None:
        if leaf >= self.size:
            while leaf >= self.size:
                self.size *= 2
            self.keys += [self.LAST] * (self.size - len(self.keys))
            self.winner = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self._play(node)
        self.keys[leaf] = key
        node = (self.size + leaf) // 2
        while node:
            self._play(node)
            node //= 2

    def _play(self, node: int) -> None:
        a, b = self.winner[2 * node], self.winner[2 * node + 1]
        self.winner[node] = b if self.keys[b] < self.keys[a] else a

    def best(self) -> tuple[int, tuple]:
        leaf = self.winner[1] if self.size > 1 else 0
        return leaf, self.keys[leaf]


_ROW = ("doc_id", "n_words", "n_features", "weight", "score")
_NO_ID = (1 << 63) - 1


def _keys(score: list[int], ids: list[int | None], run: int) -> list[tuple]:
    return [(-s, i is None, _NO_ID if i is None else i, run) for s, i in zip(score, ids, strict=True)]


def merge(blocks: Iterator[tuple[int, list[list]]], before: int, wanted: int) -> Iterator[tuple[list[list], list[int | None]]]:
    """Columns of rows with their ranks, counted on from `before`, None from `wanted` on.

    blocks: (run, columns) in the order of their first rows, each sorted, each run's in its order.
    """
    tree, leaves, held, at, rank, out = Tournament(), {}, {}, {}, before, []

    def flush() -> tuple[list[list], list[int | None]]:
        return [[columns[k][i] for columns, i in out] for k in range(len(_ROW))], list(range(rank - len(out) + 1, rank + 1))

    def take_until(limit: tuple) -> Iterator:
        nonlocal rank, out
        while rank < wanted:
            leaf, key = tree.best()
            if key == Tournament.LAST or key > limit:
                return
            columns, keys = held[leaf]
            i = at[leaf]
            out.append((columns, i))
            rank += 1
            at[leaf] = i + 1
            tree.put(leaf, keys[i + 1] if i + 1 < len(keys) else Tournament.LAST)
            if len(out) == 8 * BLOCK:
                yield flush()
                out = []

    for run, columns in blocks:
        keys = _keys(columns[4], columns[0], run)
        yield from take_until(keys[0])
        if rank >= wanted:  # enough: what still comes isn't merged
            yield columns, [None] * len(keys)
            continue
        leaf = leaves.setdefault(run, len(leaves))  # its block before is used up: that one's last row is at or before this one's first
        held[leaf], at[leaf] = (columns, keys), 0
        tree.put(leaf, keys[0])
    yield from take_until(Tournament.LAST)
    if out:
        yield flush()
    if rank >= wanted:
        for leaf, (columns, keys) in held.items():
            if at[leaf] < len(keys):
                yield [c[at[leaf] :] for c in columns], [None] * (len(keys) - at[leaf])


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of a stored table of weigh()'s with rank: 1, 2, 3 ... by score, then id, for the percentage of eligible rows that is drawn."""
    spark = scored.sparkSession
    scored = scored.select(*_ROW)
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    total, lo, hi = scored.filter(able).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = percent * total // 100
    undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return undrawn
    place = _place(lo or 0, hi or 0)
    n = max(LEAST_RANGES, -(-total // range_rows))
    shares = [k / n for k in range(1, n)]
    bounds = np.unique(np.array(scored.filter(able).agg(F.percentile_approx(place, shares, 10 * n)).first()[0], float))
    counts = np.zeros(len(bounds) + 1, np.int64)
    for r in _range_counts(scored.filter(able).select(place.alias("place")), bounds).toLocalIterator():  # a row for each range
        counts[r["range"]] = r["n"]
    upto = np.cumsum(counts)
    last = int(np.searchsorted(upto, wanted))  # the range in which the draw ends
    inside = able & (place <= float(bounds[last])) if last < len(bounds) else able
    start = spark.sparkContext.broadcast((bounds, np.concatenate([[0], upto])))

    runs = scored.filter(inside).withColumn("place", place).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    schema = "range int, run int, part int, first_score long, first_id long, " + ", ".join(f"{c} array<long>" for c in _ROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part = TaskContext.get().partitionId(), 0
        for b in batches:
            found = np.searchsorted(start.value[0], b.column("place").to_numpy(), "left")
            new = np.flatnonzero(np.diff(found)) + 1
            cuts = sorted({0, *new.tolist(), *range(0, b.num_rows, block)}) + [b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    cells = {c: b.column(c).slice(i, j - i) for c in _ROW}
                    head = {"range": int(found[i]), "run": run, "part": part, "first_score": cells["score"][0].as_py(), "first_id": cells["doc_id"][0].as_py()}
                    whole = np.array([0, j - i])
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(head.values(), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)), *(pa.ListArray.from_arrays(pa.array(whole, pa.int32()), x) for x in cells.values())], names=[*head, *_ROW])
                    part += 1

    packed = runs.mapInArrow(pack, schema).repartition(last + 1, "range")
    packed = packed.sortWithinPartitions("range", F.col("first_score").desc(), F.col("first_id").asc_nulls_last(), "run", "part")

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("range")[i].as_py(), b.column("run")[i].as_py(), [b.column(c)[i].as_py() for c in _ROW]) for b in batches for i in range(b.num_rows))
        for k, own in _by_first(rows):
            for columns, ranks in merge(own, int(start.value[1][k]), wanted):
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ranks, pa.int64())], names=[*_ROW, "rank"])

    merged = packed.mapInArrow(play, ", ".join(f"{c} long" for c in (*_ROW, "rank")))
    return merged.unionByName(undrawn.filter(~inside))


def _place(lo: int, hi: int) -> Column:
    """A number that rises along the order by score (down), then id (up): equal at most for rows near each other."""
    span = float(hi - lo + 1)
    return -F.col("score").cast("double") + F.coalesce((F.col("doc_id").cast("double") - float(lo)) / span, F.lit(1.0)) * 0.999


def _range_counts(places: DataFrame, bounds: np.ndarray) -> DataFrame:
    sent = places.sparkSession.sparkContext.broadcast(bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(sent.value, b.column("place").to_numpy(), "left"), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["range", "n"])

    return places.mapInArrow(count, "range int, n long").groupBy("range").agg(F.sum("n").alias("n"))


def _by_first(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Consecutive rows of an equal first value, without it."""
    from itertools import groupby

    for k, own in groupby(rows, key=lambda r: r[0]):
        yield k, (r[1:] for r in own)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs."""
    counts = [{r["bucket"]: r["n"] for r in bucket_counts(d, c, longest, buckets).collect()} for d, c in ((docs, text_col), (target, target_col))]
    scored = stored(weigh(docs, gains(*counts, buckets), id_col, text_col, longest, seed))
    return draw(scored, percent, least_words)
