"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over every training text: each task adds up its own counts by language and
emits them in blocks of buckets, so that what is shuffled is bounded by languages x buckets x
tasks (one that meets very many languages emits what it has from time to time), and blocks are summed in
parallel, in two steps, so that no task gets a block from all
tasks. The log-probability matrix (languages x buckets, of checked size) is broadcast. A text is
scored by its sparse counts: its distinct buckets' rows of the matrix, times their counts, are added
up in numpy, CELLS numbers at a time. Texts are looked at PIECE characters at a time, so that a task holds a long
text and its lower-cased form, and little else. With more languages than a matrix may
hold, one matrix after another is sent and dropped; each pass keeps a text's best language so far
and the sum of all probabilities.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows whose language
is null are not learned from; with no training rows every text is `und`; ties go to the
language that sorts first; rows are independent, so repeated rows get equal results. Other
columns are kept; one named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.arrow_text import mix, slices
from stackroom.session import cut

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Bytes of text handled at once (one text at least), and characters whose n-grams are.
SLICE_BYTES, PIECE = 1 << 18, 1 << 18
#: Numbers held at once for entries x languages and for texts x languages, and for a task's counts before they are emitted.
CELLS, MOST_COUNTS = 1 << 20, 1 << 23
#: Added to each count.
SMOOTHING = 0.5
_BLOCK = 2048
#: Languages x buckets of one matrix that is broadcast (128 MB of float32).
MOST_CELLS = 1 << 25
#: Groups of tasks whose counts are summed before those of all are.
_GROUPS = 256


def _letters(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def _entries(texts: list[str], orders: tuple[int, ...], buckets: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' sparse counts, some texts at a time: text, bucket and how many of the text's n-grams fall into it.

    Texts are lower-cased; characters are code points, all ASCII characters but letters count as one.
    """
    some: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if len(text) > piece:  # alone, and its pieces' counts as one
            total = np.zeros(buckets, np.int64)
            for at in range(0, len(text), piece):
                _, bucket, n = _counted([text[at : at + piece + max(orders) - 1]], orders, buckets, piece)
                total[bucket] += n
            bucket = np.flatnonzero(total)
            yield np.full(len(bucket), i), bucket, total[bucket]
            continue
        if held + len(text) > piece:
            text_, bucket, n = _counted([texts[j] for j in some], orders, buckets)
            yield np.array(some, np.int64)[text_], bucket, n
            some, held = [], 0
        some.append(i)
        held += len(text)
    if some:
        text_, bucket, n = _counted([texts[j] for j in some], orders, buckets)
        yield np.array(some, np.int64)[text_], bucket, n


def _counted(texts: list[str], orders: tuple[int, ...], buckets: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of these texts' n-grams; of those only that begin within the first `most` characters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ascii_other = (code < 128) & ~((code >= 97) & (code <= 122))
    code = np.where(ascii_other, np.uint64(32), code)
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters to the end of the text
    keys = []
    for n in orders:
        h = np.full(len(code), n, np.uint64)
        for k in range(n):
            h[: len(code) - k] = h[: len(code) - k] * np.uint64(0x100000001B3) + code[k:]
        begins = left >= n
        if most is not None:
            begins[most:] = False
        keys.append(text[begins] * buckets + (mix(h[begins]) & np.uint64(buckets - 1)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // buckets, key % buckets, count


@dataclass
class Model:
    """log_p[bucket, language] with all orders in one space, prior by language."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    buckets: int


@dataclass
class Sharded:
    """Models of some of the languages each, one at a time, in the order of their languages."""

    counts: DataFrame
    languages: list[list[str]]
    priors: list[np.ndarray]
    orders: tuple[int, ...]
    buckets: int

    def models(self) -> Iterator[Model]:
        for names, prior in zip(self.languages, self.priors, strict=True):
            yield Model(names, _matrix(self.counts, names, self.buckets), prior, self.orders, self.buckets)


def _matrix(counts: DataFrame, languages: list[str], buckets: int) -> np.ndarray:
    """log_p of these languages: so many cells come to the driver, whatever the corpus."""
    total = np.full((buckets, len(languages)), SMOOTHING)
    size, at = min(_BLOCK, buckets), {x: j for j, x in enumerate(languages)}
    for r in counts.filter(F.col("lang").between(languages[0], languages[-1])).toLocalIterator() if languages else ():
        total[r["block"] * size : (r["block"] + 1) * size, at[r["lang"]]] += np.frombuffer(r["counts"], "<i8")
    return np.log(total / total.sum(axis=0)).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, most_cells: int = MOST_CELLS) -> Model | Sharded:
    """Learn from every row with a language for which `where` holds; Sharded when one matrix of most_cells can't hold all languages."""
    rows = docs.filter(where) if where is not None else docs
    rows = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        most = max(1, MOST_COUNTS // buckets)
        for whole in slices(batches, "text", SLICE_BYTES):
            for k in range(0, whole.num_rows, most):  # so many languages at most
                b = whole.slice(k, most)
                texts = _lower(b.column("text"))
                names, which = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                for name, n in zip(names.tolist(), np.bincount(which, _letters(texts), len(names)).tolist(), strict=True):
                    total.setdefault(name, np.zeros(buckets, np.int64))
                    seen[name] = seen.get(name, 0) + int(n)
                for text, bucket, n in _entries(texts, orders, buckets):
                    order = np.argsort(which[text], kind="stable")
                    bounds = np.searchsorted(which[text][order], np.arange(len(names) + 1))
                    for j in np.flatnonzero(np.diff(bounds)).tolist():
                        own = order[bounds[j] : bounds[j + 1]]
                        total[names[j]] += np.bincount(bucket[own], n[own], buckets).astype(np.int64)
                if len(total) * buckets > MOST_COUNTS:
                    yield from emitted(total, seen)
                    total, seen = {}, {}
        yield from emitted(total, seen)

    def emitted(total: dict[str, np.ndarray], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for name, own in total.items():
            size = min(_BLOCK, buckets)
            k = buckets // size
            group = TaskContext.get().partitionId() % _GROUPS
            yield pa.RecordBatch.from_pydict({"lang": [name] * k, "block": list(range(k)), "task": [group] * k, "n": [seen[name]] * k, "counts": [own[i * size : (i + 1) * size].astype("<i8").tobytes() for i in range(k)]}, schema=pa.schema([("lang", pa.string()), ("block", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
        return pdf.iloc[:1].assign(n=pdf["n"].sum(), counts=[total.astype("<i8").tobytes()])

    schema = "lang string, block int, task int, n long, counts binary"
    found = rows.mapInArrow(count, schema).groupBy("lang", "block", "task").applyInPandas(add, schema).groupBy("lang", "block").applyInPandas(add, schema)
    found = cut(found)
    seen = sorted((r["lang"], r["n"]) for r in found.filter("block = 0").select("lang", "n").toLocalIterator())
    languages, n = [x for x, _ in seen], np.array([x for _, x in seen], float)
    prior = np.log((n + 1) / (n + 1).sum()) if languages else n
    each = max(1, most_cells // buckets)
    if len(languages) <= each:
        return Model(languages, _matrix(found, languages, buckets), prior, orders, buckets)
    parts = range(0, len(languages), each)
    return Sharded(found, [languages[k : k + each] for k in parts], [prior[k : k + each] for k in parts], orders, buckets)


def _lower(col: pa.Array) -> list[str]:
    return [(t or "").lower() for t in col.to_pylist()]


def _totals(m: Model, texts: list[str]) -> np.ndarray:
    """Each text's log score by language: its buckets' rows of the matrix, times their counts."""
    total = np.tile(m.prior, (len(texts), 1))
    if not m.languages:
        return total
    most = max(1, CELLS // len(m.languages))
    for text, bucket, count in _entries(texts, m.orders, m.buckets):
        for k in range(0, len(text), most):
            own = text[k : k + most]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] += np.add.reduceat(m.log_p[bucket[k : k + most]] * count[k : k + most, None].astype(np.float64), first, axis=0)
    return total


def _scored(batches: Iterator[pa.RecordBatch], m: Model, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of bounded bytes and of bounded texts x languages, with texts' scores by language and whether they have a letter."""
    most = max(1, CELLS // max(1, len(m.languages)))
    for b in slices(batches, column, SLICE_BYTES):
        for k in range(0, b.num_rows, most):
            part = b.slice(k, most)
            texts = _lower(part.column(column))
            yield part, _totals(m, texts), _letters(texts)


def predict(docs: DataFrame, model: Model | Sharded, text_col: str = "text") -> DataFrame:
    """All columns with lang_pred and score (the posterior probability of lang_pred)."""
    if isinstance(model, Sharded):
        return _predict_sharded(docs, model, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b, total, letters in _scored(batches, m, text_col):
            if m.languages:
                best = total.argmax(axis=1)
                p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, p, letters = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            pred = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            columns = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(np.where(letters, np.minimum(p, 1.0), 0.0))], names=[f.name for f in schema])

    return docs.select(*[f.name for f in kept]).mapInArrow(score, schema)


def _predict_sharded(docs: DataFrame, model: Sharded, text_col: str) -> DataFrame:
    """One pass for each matrix; rows are written in between, so that a task and the driver hold one matrix."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"), F.lit("und").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("sum"))
    schema = rows.schema
    for m in model.models():
        sent = docs.sparkSession.sparkContext.broadcast(m)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b, total, letters in _scored(batches, m, "text"):
                own, before = total.max(axis=1), b.column("top").to_numpy()
                best = [m.languages[k] if new else old for k, new, old in zip(total.argmax(axis=1).tolist(), (letters & (own > before)).tolist(), b.column("best").to_pylist(), strict=True)]
                sums = np.logaddexp(b.column("sum").to_numpy(), own + np.log(np.exp(total - own[:, None]).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(best, pa.string()), pa.array(np.maximum(own, before)), pa.array(sums)], names=schema.names)

        rows = cut(rows.mapInArrow(score, schema))
        sent.destroy()
    p = F.when(F.col("best") == "und", F.lit(0.0)).otherwise(F.least(F.exp(F.col("top") - F.col("sum")), F.lit(1.0)))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.col("best").alias("lang_pred"), p.alias("score"))


def identify(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows for which `where` holds, predict all rows."""
    return predict(docs, train(docs, text_col, lang_col, where), text_col)


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents, columns as they were, whose language is known with at least this probability."""
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("text"))
    found = predict(own, train(docs, text_col, lang_col))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
