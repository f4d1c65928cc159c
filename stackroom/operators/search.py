"""Retrieval: inverted index, BM25, vectors, fusion, the gate of semantic search, validation and highlighting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions.text import carries_meaning, plain_tokens, searchable
from stackroom.plans.query import Index, Query, compile
from stackroom.session import cut, delete, shared_folder, state_of

PER_BRANCH, FUSED, RRF_K = 50, 30, 60


def build_index(docs: DataFrame, analyze=plain_tokens, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index over documents; statistics are those of all documents, whatever a query's scope.

    Nothing runs here. At scale postings are written once, clustered by term (write_index), and read back.
    """
    return Index(tokens=docs.select(F.col(id_col).alias("doc_id"), analyze(F.col(text_col)).alias("tokens")))


def write_index(index: Index, path: str, partitions: int | None = None) -> None:
    """Write postings dealt out and sorted by term, so that a query's terms read a few row groups; documents with their lengths, the totals, and terms with their frequencies.

    Texts are analysed once, and a document's postings come from its own row: what is shuffled is each posting once. Unless said
    otherwise, partitions are of the size that Spark aims at, and a very frequent term goes to several.
    """
    spark = index.documents.sparkSession
    read = lambda name: spark.read.parquet(f"{path}/{name}")

    def write(rows: DataFrame, name: str) -> None:
        dealt = rows.repartition(partitions, "term") if partitions else rows.hint("rebalance", "term")
        dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/{name}")

    write(index.places(), "postings")
    read("postings").filter("term is null").select("doc_id", "dl").write.mode("overwrite").parquet(f"{path}/documents")
    read("documents").agg(F.count("*").alias("n"), F.avg("dl").alias("average")).write.mode("overwrite").parquet(f"{path}/totals")
    if Index(lengths=read("documents")).repeated:
        rows = read("postings").filter("term is not null").groupBy("term", "doc_id", "dl")
        write(rows.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")), "merged")
        delete(spark, f"{path}/postings")
        write(read("merged"), "postings")
        delete(spark, f"{path}/merged")
    terms = statistics(Index(stored=read("postings").filter("term is not null")))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(stored=read("postings").filter("term is not null"), lengths=read("documents"), vocabulary=read("terms"), totals=read("totals").first())


_WRITTEN: dict[tuple[str, str, str], tuple[str, str, Index]] = {}


def index_of(docs: DataFrame, name: str, analyze=plain_tokens) -> Index:
    """The written index of these documents by this analyzer, in the shared folder: built once in a session under this name, and read from then on.

    When the documents' files have changed since, it is built anew and the old one deleted.
    """
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name, f"{analyze.__module__}.{analyze.__qualname__}")
    state = state_of(docs)
    if key in _WRITTEN and _WRITTEN[key][0] != state:
        delete(spark, _WRITTEN.pop(key)[1])
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_index(build_index(docs, analyze), path)
        _WRITTEN[key] = state, path, read_index(spark, path)
    return _WRITTEN[key][2]


def statistics(index: Index) -> DataFrame:
    """Document frequency of each term, and how often it stands in all."""
    if index.stored is None and not index.repeated:
        return index.counts().groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best, ties by key; scores to six decimals so that the order is the same everywhere."""
    return scored.select(key, F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def keyword(index: Index, q: Query, k: int = PER_BRANCH, scope: DataFrame | None = None) -> DataFrame:
    """BM25 top k within a scope of documents; the scope narrows before the limit, never after."""
    found = compile(q, index)
    return top(found if scope is None else found.join(scope.select("doc_id").distinct(), "doc_id", "left_semi"), k)


def keyword_by_collection(docs: DataFrame, index: Index, plain: Query, expanded: dict[str, Query], k: int = PER_BRANCH) -> DataFrame:
    """Collections with synonyms of their own are asked their own query, the others the plain one; scores are of one index."""
    owner = docs.select("doc_id", "collection")
    rest = owner if not expanded else owner.filter(~F.col("collection").isin(*expanded))
    found = compile(plain, index).join(rest, "doc_id", "left_semi")
    for name in sorted(expanded):
        found = found.union(compile(expanded[name], index).join(owner.filter(F.col("collection") == name), "doc_id", "left_semi"))
    return top(found, k)


def has_anchor(index: Index, tokens: list[str], scope: DataFrame | None = None) -> DataFrame:
    """One row (anchored): whether a word of three characters or more begins an indexed term in scope."""
    words = [t for t in tokens if len(t) >= 3]
    test = F.lit(False)
    for w in words:
        test = test | F.col("term").startswith(w)
    rows = index.terms(test)
    rows = rows if scope is None else rows.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.limit(1).agg((F.count("*") > 0).alias("anchored"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = PER_BRANCH, key: str = "vec_id", column: str = "embedding", scope: DataFrame | None = None) -> DataFrame:
    """Exact top k by (1 + dot) / 2."""
    rows = vectors if scope is None else vectors.join(scope.select(key).distinct(), key, "left_semi")
    rows = rows.filter(F.size(column) == len(query))
    return top(rows.select(key, ((1 + dot(F.col(column), F.array(*map(F.lit, query)))) / 2).alias("score")), k, key)


#: Bytes of query vectors and of their best rows that a task of nearest_many holds.
QUERY_BYTES = 64 << 20
#: Scores that such a task computes at once.
CELLS = 1 << 20


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 1024, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact top k for many queries (query_id, vector), with rank: blocks of queries are multiplied with each batch of vectors.

    Queries are streamed to the driver once, in groups of most_bytes at most with their best rows;
    each group is one scan of the vectors, and its result is written before the next group is sent.
    Each task keeps k rows for each query, so what is shuffled is tasks x queries x k rows. A batch
    is multiplied in parts, so that a task holds CELLS scores at once, however many queries and vectors there are.
    """
    return best_many(vectors, queries.select("query_id", "vector"), k, key, column, block, most_bytes)


def best_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, column: str, block: int = 1024, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """nearest_many() where queries may have a third column, `lists`: a bit for each list whose vectors the query meets; vectors then have their `list`."""
    groups, held, size = [], [], 0
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    listed = "lists" in queries.columns

    def ask() -> None:
        bits = np.frombuffer(b"".join(r["lists"] for r in held), np.uint8).reshape(len(held), -1) if listed else None
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in held], np.int64), np.array([r["vector"] for r in held], np.float32), bits))
        found = vectors.select(key, column, *(["list"] if listed else [])).mapInPandas(_best_of(sent, k, key, column, block, max(1, CELLS // min(block, len(held)))), f"query_id long, {key} long, score double")
        groups.append(cut(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)))
        sent.destroy()

    for r in queries.toLocalIterator():
        own = 4 * len(r["vector"]) + 16 * k + (len(r["lists"]) if listed else 0)
        if held and size + own > most_bytes:
            ask()
            held, size = [], 0
        held.append(r)
        size += own
    if held:
        ask()
    return reduce(DataFrame.unionByName, groups) if groups else vectors.limit(0).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


class _Best:
    """The best k rows of each query so far, by score and then by key."""

    def __init__(self, queries: int, k: int):
        self.k, self.seen = k, np.zeros(queries, np.int64)
        self.scores, self.keys = np.full((queries, k), -np.inf, np.float32), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, asked: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Rows by their scores for some queries: only those that reach a query's worst row so far are sorted."""
        k, n = self.k, scores.shape[1]
        self.seen[asked] += n
        worst = self.scores[asked, -1]
        fit = scores >= worst[:, None]
        if n > k and np.count_nonzero(fit) > 4 * k * len(asked):
            fit = scores >= np.maximum(worst, np.partition(scores, n - k, axis=1)[:, n - k])[:, None]
        row, col = np.nonzero(fit)
        touched = np.unique(row)
        own = asked[touched]
        of = np.concatenate([np.repeat(np.arange(len(own)), k), np.searchsorted(touched, row)])
        s = np.concatenate([self.scores[own].ravel(), scores[row, col]])
        names = np.concatenate([self.keys[own].ravel(), keys[col]])
        order = np.lexsort((names, -s, of))
        first = np.searchsorted(of[order], np.arange(len(own)))
        kept = order[np.arange(len(order)) - first[of[order]] < k]
        self.scores[own], self.keys[own] = s[kept].reshape(-1, k), names[kept].reshape(-1, k)


def _best_of(sent, k: int, key: str, column: str, block: int, rows: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, bits = sent.value
        best, all_of_them = _Best(len(ids), k), np.arange(len(ids))
        for b in batches:
            if not len(b):
                continue
            # the queries that meet a list are those with its bit
            for at_list, pdf in [(None, b)] if bits is None else b.groupby("list"):
                asked = all_of_them if bits is None else np.flatnonzero(bits[:, at_list >> 3] >> (7 - (at_list & 7)) & 1)
                keys, matrix = pdf[key].to_numpy(), np.stack(pdf[column]).astype(np.float32)
                for first in range(0, len(keys), rows):
                    part, own = matrix[first : first + rows].T, keys[first : first + rows]
                    blank = np.isnan(part).any()
                    for at in range(0, len(asked), block):
                        s = q[asked[at : at + block]] @ part
                        best.add(asked[at : at + block], np.where(np.isnan(s), np.float32(-np.inf), s) if blank else s, own)
        has = np.arange(k) < best.seen[:, None]
        if has.any():
            yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], has.shape)[has], key: best.keys[has], "score": best.scores[has].astype(float)})

    return search


def fuse(a: DataFrame, b: DataFrame, key: str = "doc_id", k: int = RRF_K, most: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of two ranked branches (key, score): sum of 1 / (k + rank), ties by key."""
    w = Window.partitionBy().orderBy(F.col("score").desc(), key)  # a branch has PER_BRANCH rows at most
    rank = lambda df, name: df.select(key, F.row_number().over(w).alias(name))
    both = rank(a, "ra").join(rank(b, "rb"), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    by = F.when(F.col("ra").isNull(), "semantic").when(F.col("rb").isNull(), "keyword").otherwise("both")
    return both.select(key, F.round(part("ra") + part("rb"), 9).alias("score"), by.alias("matched_by")).orderBy(F.col("score").desc(), key).limit(most)


def valid(rows: DataFrame, live: DataFrame, semantic: bool = False) -> DataFrame:
    """Rows that may be hits: searchable, meaningful in the semantic branch, of a live document. Filters stand before any ranking."""
    out = rows.filter(searchable(F.col("text")))
    out = out.filter(carries_meaning(F.col("text"))) if semantic else out
    return out.join(live.select("doc_id").distinct(), "doc_id", "left_semi")


class IndexRebuildRequired(ValueError):
    """The stored vectors come from another model than the query's."""


def check_identity(identity: DataFrame, wanted: dict[str, object]) -> None:
    """One stored row must say the same of schema, model, revision and dimension."""
    row = identity.first()
    if row is None or any(row[k] != v for k, v in wanted.items()):
        raise IndexRebuildRequired("the index must be rebuilt")


def search(index: Index, q: Query, tokens: list[str], vectors: DataFrame, query_vector: list[float], mode: str = "HYBRID", scope: DataFrame | None = None, need_anchor: bool = True) -> DataFrame:
    """KEYWORD and SEMANTIC give up to PER_BRANCH rows, HYBRID up to FUSED of both branches.

    With need_anchor, the semantic branch counts only if the keyword branch or an anchor found something: a semi-join with one row, not a job of its own.
    """
    ids = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    words = keyword(index, q, PER_BRANCH, scope)
    if mode == "KEYWORD":
        return words
    near = nearest(ids, query_vector, PER_BRANCH, "doc_id", "embedding", scope)
    if need_anchor:
        gate = has_anchor(index, tokens, scope).filter("anchored").select(F.lit(1).alias("g")).union(words.limit(1).select(F.lit(1))).distinct()
        near = near.withColumn("g", F.lit(1)).join(gate, "g", "left_semi").drop("g")
    return near if mode == "SEMANTIC" else fuse(words, near)


def rank_metrics(a: Column, b: Column, depth: int = 10, p: float = 0.9) -> tuple[Column, Column, Column]:
    """Overlap, same first, and rank-biased overlap of two ranked lists, to a depth."""
    common = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d)))
    rbo = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) * common(d) / d)
    return common(F.lit(depth)) / float(depth), F.element_at(a, 1) == F.element_at(b, 1), rbo * (1 - p)


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_WORD = re.compile(r"\w+")


def _fold(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def highlighted(text: str, tokens: list[str], phrases: list[list[str]] = ()) -> str | None:
    """The text, escaped, with <mark> around words that contain a token and around runs that are a phrase; None if there are none."""
    words = [(m.start(), m.end(), _fold(m[0])) for m in _WORD.finditer(text)]
    marked = [any(t in w for t in tokens) for _, _, w in words]
    for phrase in phrases:
        for i in range(len(words) - len(phrase) + 1):
            if [w for _, _, w in words[i : i + len(phrase)]] == list(phrase):
                marked[i : i + len(phrase)] = [True] * len(phrase)
    if not any(marked):
        return None
    out, at = [], 0
    for (s, e, _), m in zip(words, marked, strict=True):
        if m:
            out.append(f"{text[at:s].translate(_ESCAPES)}<mark>{text[s:e].translate(_ESCAPES)}</mark>")
            at = e
    return "".join([*out, text[at:].translate(_ESCAPES)])


def highlight(text: Column, tokens: list[str], phrases: list[list[str]] = ()) -> Column:
    """highlighted() over a column, in Arrow batches."""
    folded, runs = [_fold(t) for t in tokens], [[_fold(w) for w in p] for p in phrases]

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else highlighted(t, folded, runs))

    return mark(text)
