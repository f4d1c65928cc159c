"""Near-duplicate documents by HyperMinHash over five-word shingles.

A document is its set of shingles. One pass over the text gives each set's size, a 128-bit
fingerprint and 64 HyperMinHash registers: of the hashes in a bucket the smallest is kept as its
leading-zero count (6 bits) and the 10 bits that follow. Documents with equal sets become one
representative first, so that groups of copies cost one row from there on.

Registers are banded three at a time. The members of a band's bucket are paired with each other where
they are FEW; in larger buckets every member is paired with one pivot only, the member that shares
most buckets (in large groups another may take its place, if it is nearer to the others). Those pairs are verified on their full sets. What can still be linked although one of the two isn't linked with the pivot has much in
common that the pivot lacks, or lacks much together, as this shows:

  Let D be a set's difference with the pivot p, A what it has more and M what it lacks, and
  t = (1 - T) / (1 + T) for the similarity T; x and y are linked if and only if
  |D_x| + |D_y| - 2 |D_x & D_y| <= t (|x| + |y|). If x isn't linked with p, |D_x| > t (|x| + |p|).
  If x and y share nothing of A, then |D_x & D_y| <= |M_y|, so a link needs
  |p| - |y| >= |D_x| - t (|x| + |y|), and they share some of M; if y isn't linked with p
  either, the same holds for y, and both sum up to |A_x| + |A_y| <= t (|x| + |y|). If they do share
  some of A, it is at least (|A_x| + |A_y| - t (|x| + |y|)) / 2 of it.

So members of a pivot's group are joined on what they have more (its rarest part, long enough to
hold one of the shared ones) and, where the sizes allow, on what they lack; pairs whose sizes or
whose Jaccard estimate (register agreement less the agreement expected by chance) are far below the
threshold go, as do pairs of which one has so many more edits of a kind than the other that they can't be linked, and the rest are verified on their full sets. No pair that shares a bucket and
could connect two components is left out; what is joined are edits, not the texts that a group has
in common. Most of a large group's members are linked with its pivot or with each other, so only what
is not of a token's most frequent component is paired, with all others: the work grows with a group's size, not its square.

Skew: copies are folded by a partial aggregation; pivots are maxima (partial aggregation); both
sides of the joins with bands' sizes and with pivots are shuffled by themselves, so that Spark can
split a hot key.

Defined cases: null, empty and wordless texts have an empty set, no link, and are kept; a text of
fewer words than a shingle is its whole sequence; a repeated row (same id)
gets its text's result; a null id never names a component: it is linked through documents
with an id and the same set, else its component is null and it is kept; an empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.llm.arrow_text import SPACED_LOWER, list_array, mix, shingles, slices, tokenize
from stackroom.llm.components import apart, components
from stackroom.session import cut

WIDTH = 5
BUCKET_BITS, MANTISSA_BITS = 6, 10
REGISTERS = 1 << BUCKET_BITS
ROWS = 3
BANDS = REGISTERS // ROWS
#: An estimate this far below the threshold is not verified: near eight standard deviations with 64 registers.
MARGIN = 0.35
#: Members of a bucket that are all paired with each other, and members of a group from which on a better pivot is looked for.
FEW, LARGE = 8, 32
#: Members that may become a large group's pivot.
NEAREST = 8
#: Bytes of sets in one part.
SET_BYTES = 16 << 20
#: Ids that may be broadcast (16 bytes each).
MOST_SENT = 200_000


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and where each text's begin (with the count at the end)."""
    tok = tokenize(col, SPACED_LOWER)
    values, rows = shingles(tok, WIDTH, True)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(rows)))


def registers(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x 64) of sorted sets; 0 where a bucket is empty."""
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    slot = text * REGISTERS + bucket
    first = np.ones(len(values), bool)
    first[1:] = slot[1:] != slot[:-1]
    rest = (values[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as a float
    m, e = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 53, 53 - e)
    mantissa = np.where(rest == 0, 0, (m * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = np.zeros((len(rows) - 1) * REGISTERS, np.uint16)
    out[slot[first]] = 1 + (zeros.astype(np.int64) << MANTISSA_BITS | mantissa)
    return out.reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands that have a register, and each text's first (with the count at the end).

    A set so small that one shingle more is below the threshold can only be linked with an equal one: no band.
    """
    used = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key + used[:, :, k] * np.uint64(0xC2B2AE3D27D4EB4F))
    keep = used.any(axis=2) & (100 * sizes >= percent * (sizes + 1))[:, None]
    return key[keep].view(np.int64), np.concatenate([[0], np.cumsum(keep.sum(axis=1))])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), registers (binary), bands (array of keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, rows = shingle_sets(b.column("text"))
            size = np.diff(rows)
            f = [_fingerprint(values, rows, salt) for salt in _SALTS]
            regs = registers(values, rows)
            keys, at = band_keys(regs, size, percent)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(f[0]), pa.array(f[1]), pa.array([r.tobytes() for r in regs], pa.binary()), list_array(pa.array(keys), at)], names=["doc_id", "n_shingles", "f1", "f2", "registers", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, registers binary, bands array<long>")


def _fingerprint(values: np.ndarray, rows: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(salt)), out=sums[1:])
    return mix(sums[rows[1:]] - sums[rows[:-1]]).view(np.int64)


_SALTS = (0x9AE16A3B2F90404F, 0xC949D7C7509E6557)


def sets_of(docs: DataFrame) -> DataFrame:
    """The texts' fingerprints f1 with their sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, rows = shingle_sets(b.column("text"))
            f1 = _fingerprint(values, rows, _SALTS[0])
            yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array([values[rows[i] : rows[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["f1", "members"])

    return docs.select("text").mapInArrow(run, "f1 long, members binary")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers (pairs x 64), less the agreement that chance gives.

    Two unlike registers agree by chance with the probability that two minima share leading-zero
    count and mantissa: about 2 ** -MANTISSA_BITS by the spread of the counts.
    """
    some = (a > 0) | (b > 0)
    same = ((a == b) & some).sum(axis=1)
    n = np.maximum(some.sum(axis=1), 1)
    chance = 0.35 / (1 << MANTISSA_BITS)
    return np.clip((same / n - chance) / (1 - chance), 0, 1)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and registers allow so much similarity."""
    own = reps.select("node", "n_shingles", "registers")
    rows = pairs.join(own.toDF("a", "n_a", "r_a"), "a").join(own.toDF("b", "n_b", "r_b"), "b").filter((100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                pdf = pdf[estimate(x, y) >= percent / 100 - MARGIN]
            yield pdf[["a", "b"]]

    return rows.select("a", "b", "r_a", "r_b").mapInPandas(keep, "a long, b long")


def _narrow(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is wanted; the wanted ids are broadcast up to MOST_SENT of them, beyond that both sides are shuffled."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, on, "left_semi")


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """The full sets of the nodes, each from one of its texts; texts move once at most, for all rounds."""
    wanted = cut(reps.join(nodes.distinct(), "node", "left_semi").select("doc_id"), parts)
    return cut(sets_of(_narrow(docs, wanted, "doc_id")).dropDuplicates(["f1"]), parts)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with n_a, n_b and both, the sizes of the full sets and of what they share."""
    wanted = pairs.select(F.col("a").alias("f1")).union(pairs.select("b")).distinct()
    sets = _narrow(sets, wanted, "f1")
    rows = pairs.join(sets.toDF("a", "m_a"), "a").join(sets.toDF("b", "m_b"), "b").select("a", "b", "m_a", "m_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                sizes.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([v[k] for v in sizes], pa.int32()) for k in range(3))], names=["a", "b", "n_a", "n_b", "both"])

    return rows.mapInArrow(check, "a long, b long, n_a int, n_b int, both int")


def _edits(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (g, kind, token, x) for what a group's members have more than its pivot (kind 0) or lack (kind 1).

    What a member lacks only matters if it is linked with the pivot and smaller, or has little more
    than the pivot, or is near enough to meet a linked one.
    """
    rows = members.join(sets.toDF("x", "m_x"), "x").join(sets.toDF("p", "m_p"), "p").select("g", "x", "linked", "m_x", "m_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("token", pa.int64()), ("x", pa.int64())])
        for batch in batches:
            for g, x, linked, mine, own in zip(batch.column("g").to_pylist(), batch.column("x").to_pylist(), batch.column("linked").to_pylist(), batch.column("m_x"), batch.column("m_p"), strict=True):
                s, q = np.frombuffer(mine.as_buffer(), np.uint64), np.frombuffer(own.as_buffer(), np.uint64)
                more, less = np.setdiff1d(s, q, assume_unique=True), np.setdiff1d(q, s, assume_unique=True)
                if linked:
                    lacks = len(s) < len(q)
                else:
                    smallest = -(-percent * max(len(s), len(q)) // 100)  # a linked one of a size that fits
                    near = (100 + percent) * (len(q) - smallest - len(more) - len(less)) + (100 - percent) * (len(s) + smallest) >= 0
                    lacks = near or percent * (100 + percent) * len(more) <= (100 - percent) * (100 + percent) * len(s) + 100
                for kind, tokens in enumerate((more, less if lacks else less[:0])):
                    n = len(tokens)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(np.full(n, kind, np.int32)), pa.array(tokens.view(np.int64)), pa.array(np.full(n, x))], schema=schema)

    return rows.mapInArrow(run, "g long, kind int, token long, x long")


def _better_pivots(stars: DataFrame, sets: DataFrame, alike, parts: int) -> tuple[DataFrame, DataFrame]:
    """Stars (g, a, b, n_a, n_b, both) with the best pivot b of each group g, and all links found on the way.

    In large groups the members nearest to the pivot (NEAREST of them at most) are measured by their
    distance to some of the group's members; if another than the pivot is nearest to them, it is
    compared with all and takes the pivot's place. A group's text without edits is nearest to all,
    and then what members have more is their own edits. The choice only bears on the work to do.
    """
    own = stars.withColumns({"g": F.col("b"), "d": F.col("n_a") + F.col("n_b") - 2 * F.col("both")})
    groups = cut(own.groupBy("g").agg(F.min("d").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= LARGE), parts)
    members = own.select("g", "a", "d").join(groups, "g")
    near = members.filter(F.col("d") <= F.col("least") + WIDTH)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d", "a"))).filter(F.col("r") <= NEAREST).select("g", F.col("a").alias("b"))
    some = members.filter(F.pmod(F.xxhash64("a", "g"), F.col("n")) < LARGE).select("g", "a")
    asked = cut(some.join(near.union(groups.select("g", "g")), "g").select("g", "a", "b"), parts)
    apart = F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n_a") + F.col("n_b") - 2 * F.col("both"))
    measured = asked.join(_compared(asked.select("a", "b").filter("a <> b").distinct(), sets), ["a", "b"], "left").groupBy("g", "b").agg(F.sum(apart).alias("d"))
    best = measured.groupBy("g").agg(F.min(F.struct("d", F.when(F.col("b") == F.col("g"), 0).otherwise(1), "b")).alias("x")).select("g", F.col("x.b").alias("b")).filter("b <> g")
    best = cut(best, parts)
    pairs = own.select("g", "a").union(best.select("g", "g")).join(best, "g").filter("a <> b").select("g", "a", "b")
    other = cut(pairs.join(_compared(pairs.select("a", "b").distinct(), sets), ["a", "b"]), parts)
    kept = own.drop("d").join(best.select("g"), "g", "left_anti").unionByName(other)
    return cut(kept, parts), stars.filter(alike).select("a", "b").union(other.filter(alike).select("a", "b")).distinct()


def _beside_pivots(stars: DataFrame, found: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of one group's members in different components that may be linked, by the module's lemma.

    Of the members that hold an edit, those of the most frequent component (nearly all of a large
    group) are not paired with each other, and an edit that one component alone holds, or linked members alone, pairs nobody.
    """
    linked = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    members = stars.select("g", F.col("b").alias("p"), F.col("a").alias("x"), "n_a", "n_b", "both", linked.alias("linked"))
    members = members.join(found.toDF("x", "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    groups = members.groupBy("g").agg(F.min("linked").alias("all_linked"), F.count("*").alias("n")).filter("not all_linked and n > 1").select("g")
    more, less = F.col("n_a") - F.col("both"), F.col("n_b") - F.col("both")
    # all by 100 + percent: x and y, with nothing more in common, can only be linked if spare(y) >= far(x) for an x that isn't linked with the pivot
    spare, far = (100 + percent) * (F.col("n_b") - F.col("n_a")) + (100 - percent) * F.col("n_a"), (100 + percent) * (more + less) - (100 - percent) * F.col("n_a")
    members = cut(members.join(groups, "g", "left_semi").withColumns({"spare": spare, "far": far}), parts)
    reach = members.groupBy("g").agg(F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest"), F.max("spare").alias("most"))
    edits = _edits(members, sets, percent).join(members.join(reach, "g").drop("p"), ["g", "x"])
    edits = edits.filter((F.col("kind") == 0) | F.when(F.col("linked"), F.col("spare") >= F.col("nearest")).otherwise(F.col("far") <= F.col("most")))
    key = ["g", "kind", "token"]
    several = edits.groupBy(*key).agg(F.count("*").alias("df"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("linked").alias("all_linked")).filter("c1 <> c2 and not all_linked")
    shared = edits.join(several.select(*key, "df"), key)
    # the rarest part of a member's edits: those of no use come first, and of the others a member holds the rest
    t, largest = (100 - percent) / (100 + percent), F.col("n_a") * (1 + 100 / percent)
    same_more = more - t * largest
    same_less = F.when(F.col("linked"), more + less + t * (F.col("n_b") - F.col("n_a"))).otherwise(more + less - t * largest)
    needed = F.greatest(F.lit(1), F.ceil(F.when(F.col("kind") == 0, same_more).otherwise(same_less) / 2 - 1e-6))
    w = Window.partitionBy("g", "kind", "x")
    ranked = shared.withColumns({"r": F.row_number().over(w.orderBy("df", "token")), "n": F.count("*").over(w)})
    ranked = cut(ranked.filter(F.col("r") <= F.col("n") - needed + 1).select(*key, "x", "n_a", "linked", "component", "spare", "far", more.alias("more"), less.alias("less")), parts)
    each = ranked.groupBy(*key, "component").agg(F.count("*").alias("k"))
    main = each.groupBy(*key).agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("several")).filter("several > 1")
    side = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("x", "n_a", "linked", "component", "spare", "far", "more", "less")]
    n = lambda k: F.col(f"n_a{k}")
    near = lambda j, k: F.col(f"linked{j}") | (F.col(f"spare{k}") >= F.col(f"far{j}"))
    fits = (F.col("component1") != F.col("component2")) & ~(F.col("linked1") & F.col("linked2")) & (100 * F.least(n(1), n(2)) >= percent * F.greatest(n(1), n(2)))
    apart_ = F.abs(F.col("more1") - F.col("more2")) + F.abs(F.col("less1") - F.col("less2"))  # so much two sets differ at least
    fits = fits & ((100 + percent) * apart_ <= (100 - percent) * (n(1) + n(2)))
    few = ranked.join(main, key).filter(F.col("component") != F.col("main"))
    pairs = few.select(*key, *side(1)).join(ranked.select(*key, *side(2)), key).filter(fits & ((F.col("kind") == 0) | near(1, 2) & near(2, 1)))
    return pairs.select(F.greatest("x1", "x2").alias("a"), F.least("x1", "x2").alias("b")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(sketch(own, percent=percent))
    size = sketches.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    parts = max(8, -(-size["rows"] // 20_000))
    # nodes are sets, named by their fingerprint; any one of a set's documents stands for its text
    reps = cut(sketches.filter("n_shingles > 0").groupBy(F.col("f1").alias("node"), "f2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), parts)
    banded = reps.filter("doc_id is not null").select("node", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = cut(banded.select("node", apart("key")).join(sizes.select(apart("key"), "n"), "k").select("node", apart("k", "key"), "n"), parts)
    few, many = buckets.filter(F.col("n") <= FEW).select("key", "node"), buckets.filter(F.col("n") > FEW)
    small = few.join(few.toDF("key", "b"), "key").filter("node > b").select(F.col("node").alias("a"), "b").distinct()
    small = cut(_likely(small, reps, percent), parts)
    popular = many.groupBy("node").agg(F.sum("n").alias("popular"))
    pivots = many.join(popular, "node").groupBy("key").agg(F.max(F.struct("popular", "node")).alias("b")).select(apart("key"), F.col("b.node").alias("b"))
    pairs = cut(many.select("node", apart("key")).join(pivots, "k").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), parts)
    sets = _sets(own, reps, small.select(F.col("a").alias("node")).union(small.select("b")).union(pairs.select("a")).union(pairs.select("b")), max(parts, 8 * size["shingles"] // SET_BYTES + 1))
    alike = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    stars, links = _better_pivots(cut(_compared(pairs, sets), parts), sets, alike, parts)
    links = cut(links.union(_compared(small, sets).filter(alike).select("a", "b")), parts)
    found = cut(components(links, parts=parts), parts)
    more = cut(_likely(_beside_pivots(stars, found, sets, percent, parts), reps, percent), parts)
    if more.take(1):
        found = components(links.union(_compared(more, sets).filter(alike).select("a", "b")), parts=parts)

    placed = reps.join(found, "node", "left").select("node", "f2", "n_shingles", "doc_id", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names, "component").select(F.col("node").alias("f1"), "f2", "n_shingles", "component_id")
    out = sketches.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, columns as they were, of which one of each component stays; repeated rows of one id become one.

    Rows without an id all stay, as they can't be told apart. Texts only move where very many ids
    go, or for rows whose id is repeated.
    """
    found = link(docs, id_col, text_col, percent).filter("doc_id is not null")
    state = cut(found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone, twice = state.filter("not kept").select("_id"), state.filter("kept and n > 1").select("_id")
    on = docs[id_col].cast("long") == F.col("_id")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    kept = docs.join(sent(gone), on, "left_anti")
    if not twice.take(1):
        return kept
    twice = sent(twice)
    return kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates([id_col]))
