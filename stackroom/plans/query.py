"""Keyword queries as small trees, their synonym expansion, and their DataFrame plans over an index.

Queries are built from these classes, or read from what a person types (plans/strings.py). compile() turns a tree
into a lazy plan of (doc_id, score): all terms of a boolean are one filtered scan of the postings,
and clauses meet in one aggregation by document, so no clause is joined with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Clause budgets: of a whole query, added by synonyms, variants of one phrase.
MOST_CLAUSES, MOST_ADDED, MOST_VARIANTS = 1000, 256, 16


class QueryTooLong(ValueError):
    """More terms than a query may have."""


@dataclass(frozen=True)
class Query:
    """Base of all nodes."""


@dataclass(frozen=True)
class Term(Query):
    text: str


@dataclass(frozen=True)
class Phrase(Query):
    words: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Prefix(Query):
    text: str


@dataclass(frozen=True)
class Wildcard(Query):
    """`*` for any characters, `?` for one, a backslash before either for itself."""

    pattern: str


@dataclass(frozen=True)
class Regex(Query):
    pattern: str


@dataclass(frozen=True)
class Fuzzy(Query):
    text: str
    edits: int = 2


@dataclass(frozen=True)
class TermSet(Query):
    words: tuple[str, ...]


@dataclass(frozen=True)
class Everything(Query):
    pass


@dataclass(frozen=True)
class Nothing(Query):
    pass


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    by: float


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    filters: tuple[Query, ...] = ()


def clause_count(q: Query) -> int:
    """A phrase counts its words, other leaves one."""
    if isinstance(q, Bool):
        return sum(map(clause_count, (*q.must, *q.should, *q.must_not, *q.filters)))
    if isinstance(q, Boost):
        return clause_count(q.query)
    return len(q.words) if isinstance(q, Phrase) else 0 if isinstance(q, Nothing) else 1


def simplify(q: Query) -> Query:
    """Constant folding: only negative clauses match nothing, a phrase of one word is a term, single wrappers go."""
    if isinstance(q, Phrase):
        return Nothing() if not q.words else Term(q.words[0]) if len(q.words) == 1 else q
    if isinstance(q, Boost):
        inner = simplify(q.query)
        return inner if isinstance(inner, Nothing) or q.by == 1 else Boost(inner, q.by)
    if isinstance(q, Bool):
        must, should, without, filters = (tuple(map(simplify, x)) for x in (q.must, q.should, q.must_not, q.filters))
        if any(isinstance(x, Nothing) for x in (*must, *filters)):
            return Nothing()
        should, without = (tuple(x for x in y if not isinstance(x, Nothing)) for y in (should, without))
        if not (must or should or filters):
            return Nothing()
        if len(must) + len(should) == 1 and not (without or filters):
            return (*must, *should)[0]
        return Bool(must, should, without, filters)
    return q


def wildcard_regex(pattern: str) -> str:
    """A Java regular expression for a wildcard pattern over a whole term."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += quote(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c, quote(c))
        i += 1
    return out


def quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


# synonyms


@dataclass(frozen=True)
class SynonymTerm:
    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Synonyms:
    terms: tuple[SynonymTerm, ...]

    @staticmethod
    def of(texts: list[str], analyze) -> Synonyms:
        """2 to 20 distinct terms of at most 200 characters and 8 tokens; `word*` is a prefix term of 3 characters or more."""
        import unicodedata

        found: dict[tuple[str, ...], SynonymTerm] = {}
        for raw in texts:
            text = " ".join(unicodedata.normalize("NFC", raw).split())
            prefix = text.endswith("*")
            tokens = tuple(analyze(text.rstrip("*")))
            if not tokens or len(text) > 200 or len(tokens) > 8 or prefix and (len(tokens) != 1 or len(tokens[0]) < 3):
                raise ValueError(f"not a synonym: {raw!r}")
            found[tokens] = SynonymTerm(tokens, prefix or (tokens in found and found[tokens].prefix))
        if not 2 <= len(found) <= 20:
            raise ValueError("synonyms are 2 to 20 distinct terms")
        return Synonyms(tuple(found.values()))


@dataclass
class Glossary:
    groups: list[Synonyms]
    _exact: dict[str, list[tuple[SynonymTerm, Synonyms]]] = field(default_factory=dict)
    _prefix: dict[str, tuple[SynonymTerm, Synonyms]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for g in self.groups:
            for t in g.terms:
                self._exact.setdefault(t.tokens[0], []).append((t, g))
                if t.prefix:
                    self._prefix[t.tokens[0]] = (t, g)

    def hits(self, tokens: list[str]) -> list[tuple[int, int, SynonymTerm, Synonyms]]:
        """(first, end, term, group) from left to right without overlap: the longest exact run, else the longest prefix term."""
        out, at = [], 0
        while at < len(tokens):
            fits = [(len(t.tokens), t, g) for t, g in self._exact.get(tokens[at], []) if tuple(tokens[at : at + len(t.tokens)]) == t.tokens]
            if fits:
                n, t, g = max(fits, key=lambda x: x[0])
                out.append((at, at + n, t, g))
                at += n
                continue
            word = tokens[at]
            own = next((self._prefix[word[:k]] for k in range(len(word), 2, -1) if word[:k] in self._prefix), None)
            if own:
                out.append((at, at + 1, *own))
            at += 1
        return out


def _as_query(t: SynonymTerm) -> Query:
    return Prefix(t.tokens[0]) if t.prefix else Term(t.tokens[0]) if len(t.tokens) == 1 else Phrase(t.tokens)


def expand(q: Query, glossary: Glossary) -> Query:
    """The query with synonyms: optional terms gain alternatives, required ones become a required choice, phrases gain variants.

    Alternatives are a group's terms but the words that are there; a prefix term is always one, as it stands for
    other words, too. All of a place come, or none when they would go over the budget; phrase variants come one
    by one, MOST_VARIANTS beside the phrase at most, until one doesn't fit. What is excluded stays as it is, but for groups within it.
    """
    added = 0

    def room(more: list[Query]) -> bool:
        nonlocal added
        n = sum(map(clause_count, more))
        if added + n > MOST_ADDED:
            return False
        added += n
        return True

    def run(clauses: tuple[Query, ...], required: bool) -> tuple[Query, ...]:
        out: list[Query] = []
        i = 0
        while i < len(clauses):
            j = i
            while j < len(clauses) and isinstance(clauses[j], Term):
                j += 1
            if j == i:
                out.append(walk(clauses[i]))
                i += 1
                continue
            words = [c.text for c in clauses[i:j]]
            at = 0
            for first, end, _term, group in glossary.hits(words):
                out += [Term(w) for w in words[at:first]]
                own = [Term(w) for w in words[first:end]]
                others = [_as_query(t) for t in group.terms if t.prefix or list(t.tokens) != words[first:end]]
                if not others or not room(others):
                    out += own
                elif required:
                    out.append(Bool(should=(own[0] if len(own) == 1 else Bool(must=tuple(own)), *others)))
                else:
                    out += [*own, *others]
                at = end
            out += [Term(w) for w in words[at:]]
            i = j
        return tuple(out)

    def walk(node: Query) -> Query:
        if isinstance(node, Bool):
            excluded = tuple(walk(c) if isinstance(c, Bool) else c for c in node.must_not)
            return replace(node, must=run(node.must, True), should=run(node.should, False), must_not=excluded)
        if isinstance(node, Term):
            return Bool(should=run((node,), False)) if glossary.hits([node.text]) else node
        if isinstance(node, Phrase):
            choices: list[list[tuple[str, ...]]] = []
            at = 0
            for first, end, _term, group in glossary.hits(list(node.words)):
                choices += [[(w,)] for w in node.words[at:first]]
                own = tuple(node.words[first:end])
                choices.append([own, *(t.tokens for t in group.terms if t.tokens != own)])
                at = end
            choices += [[(w,)] for w in node.words[at:]]
            variants: list[Query] = []
            for k, words in enumerate(product(*choices)):
                v = Phrase(tuple(w for part in words for w in part), node.slop)
                if k > MOST_VARIANTS or k and not room([v]):
                    break
                variants.append(v)
            return variants[0] if len(variants) == 1 else Bool(should=tuple(variants))
        return node

    return walk(q)


# plans


#: Terms that a prefix, pattern or misspelling may stand for and still be sought by name; beyond, postings are joined with the vocabulary.
MOST_EXPANDED = 1024


@dataclass
class Index:
    """Places of terms: `tokens` (doc_id, tokens) as a plan over texts, or written `stored` postings with `lengths`, the `vocabulary` (term, df) and the `totals` (n, average).

    Terms are chosen before places are gathered, so a query over texts moves its own terms only,
    and over written postings it reads the row groups that hold them.
    """

    tokens: DataFrame | None = None
    stored: DataFrame | None = None
    lengths: DataFrame | None = None
    vocabulary: DataFrame | None = None
    totals: Row | None = None

    @property
    def documents(self) -> DataFrame:
        """doc_id and its number of tokens dl."""
        return self.lengths if self.lengths is not None else self.tokens.select("doc_id", F.size("tokens").alias("dl"))

    def postings(self, test: Column | None = None) -> DataFrame:
        """term, doc_id, dl, tf, positions of the terms that pass the test (all without one)."""
        if self.stored is not None:
            return self.stored if test is None else self.stored.filter(test)
        each = self.tokens.select("doc_id", F.size("tokens").alias("dl"), F.posexplode_outer("tokens").alias("position", "term"))
        each = each.filter(F.col("term").isNotNull() if test is None else test)  # outer: else a filter on tokens is put below a repartition
        return each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))

    def places(self) -> DataFrame:
        """The postings of unwritten documents as each row gives them, without a shuffle, and a row without a term for each document.

        Rows of a repeated id aren't put together.
        """
        kind = dict(self.tokens.dtypes)["doc_id"]
        return self.tokens.select("doc_id", "tokens").mapInArrow(_places, f"term string, doc_id {kind}, dl int, tf long, positions array<int>")

    def counts(self) -> DataFrame:
        """term, df, cf of unwritten documents, in parts: a row for each batch that has the term. Each row is a document of its own."""
        return self.tokens.select("tokens").mapInArrow(_counts, "term string, df long, cf long")

    @property
    def repeated(self) -> bool:
        """Whether an id stands in several rows."""
        rows = self.lengths if self.lengths is not None else self.tokens
        return bool(rows.groupBy("doc_id").count().filter("count > 1").take(1))

    def terms(self, test: Column) -> DataFrame:
        """doc_id of the documents with a term that passes the test: of a written index the vocabulary is asked first, and only those terms' postings are read."""
        if self.vocabulary is not None:
            found = self.vocabulary.filter(test).select("term")
            some = [r["term"] for r in found.limit(MOST_EXPANDED + 1).collect()]
            rows = self.stored.filter(F.col("term").isin(*some)) if len(some) <= MOST_EXPANDED else self.stored.join(found, "term", "left_semi")
            return rows.select("doc_id").distinct()
        if self.stored is not None:
            return self.stored.filter(test).select("doc_id").distinct()
        return self.tokens.select("doc_id", F.explode_outer("tokens").alias("term")).filter(test).select("doc_id").distinct()

    def statistics(self, words: list[str]) -> Statistics:
        """Number of documents, their mean length, and in how many each word stands: over all documents, in one pass over texts."""
        if self.stored is not None:
            row = self.totals or self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
            found = self.vocabulary if self.vocabulary is not None else self.stored.groupBy("term").agg(F.count("*").alias("df"))
            found = found.filter(F.col("term").isin(*words)).collect() if words else []
            return Statistics(row["n"], float(row["average"] or 1.0), {r["term"]: r["df"] for r in found})
        row = self.tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("average"), *[F.count_if(F.array_contains("tokens", w)).alias(f"w{k}") for k, w in enumerate(words)]).first()
        return Statistics(row["n"], float(row["average"] or 1.0), {w: row[f"w{k}"] for k, w in enumerate(words)})


def _grouped(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch; and sorted by row and word: row, word, place of each token, and where a row's next word begins."""
    offsets, values = tokens.offsets.to_numpy(), tokens.values
    values = values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = values.dictionary_encode()
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)
    word = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if values.null_count:
        row, place, word = row[word >= 0], place[word >= 0], word[word >= 0]
    key = row * max(len(coded.dictionary), 1) + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    return coded.dictionary, row[order], word[order], place[order], np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, dl = b.column("doc_id"), pc.list_value_length(b.column("tokens"))
        words, row, word, place, first = _grouped(b.column("tokens"))
        of = np.concatenate([row[first], np.arange(b.num_rows)])
        ends = np.concatenate([first, np.full(b.num_rows + 1, len(row))]).astype(np.int32)
        term = pa.concat_arrays([words.take(pa.array(word[first])), pa.nulls(b.num_rows, words.type)])
        columns = [term, ids.take(pa.array(of)), dl.take(pa.array(of)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "dl", "tf", "positions"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, _, word, _, first = _grouped(b.column("tokens"))
        n = [np.bincount(x, minlength=len(words)).astype(np.int64) for x in (word[first], word)]
        yield pa.RecordBatch.from_arrays([words, *map(pa.array, n)], names=["term", "df", "cf"])


@dataclass
class Statistics:
    n_docs: int
    average: float
    df: dict[str, int]

    def weight(self, tf: Column, dl: Column, df: Column) -> Column:
        idf = F.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.average))


def compile(q: Query, index: Index) -> DataFrame:
    """(doc_id, score) of the matching documents."""
    q = simplify(q)
    if clause_count(q) > MOST_CLAUSES:
        raise QueryTooLong(f"{clause_count(q)} clauses")
    words = sorted(_words(q))
    return _plan(q, index, index.statistics(words) if words else Statistics(0, 1.0, {}))


def _words(q: Query) -> set[str]:
    if isinstance(q, Bool):
        return set().union(*map(_words, (*q.must, *q.should, *q.must_not, *q.filters)))
    if isinstance(q, Boost):
        return _words(q.query)
    return {q.text} if isinstance(q, Term) else set(q.words) if isinstance(q, (Phrase, TermSet)) else set()


def _terms(index: Index, words: list[str], stats: Statistics) -> DataFrame:
    """A row (doc_id, term, score) for each of these words in each document."""
    rows = index.postings(F.col("term").isin(*words))
    n = F.coalesce(*[F.when(F.col("term") == w, F.lit(stats.df.get(w, 0))) for w in words])
    return rows.select("doc_id", "term", stats.weight(F.col("tf"), F.col("dl"), n).alias("score"))


def _constant(index: Index, test: Column) -> DataFrame:
    return index.terms(test).select("doc_id", F.lit(1.0).alias("score"))


def _plan(q: Query, index: Index, stats: Statistics) -> DataFrame:
    if isinstance(q, Term):
        return _terms(index, [q.text], stats).select("doc_id", "score")
    if isinstance(q, Boost):
        return _plan(q.query, index, stats).select("doc_id", (F.col("score") * q.by).alias("score"))
    if isinstance(q, Phrase):
        return _phrase(q, index, stats)
    if isinstance(q, Prefix):
        return _constant(index, F.col("term").startswith(q.text))
    if isinstance(q, Wildcard):
        return _constant(index, F.col("term").rlike(f"^(?:{wildcard_regex(q.pattern)})$"))
    if isinstance(q, Regex):
        return _constant(index, F.col("term").rlike(f"^(?:{q.pattern})$"))
    if isinstance(q, Fuzzy):
        near = F.abs(F.length("term") - len(q.text)) <= q.edits
        return _constant(index, near & (F.levenshtein("term", F.lit(q.text)) <= q.edits))
    if isinstance(q, TermSet):
        return _constant(index, F.col("term").isin(*q.words))
    if isinstance(q, Everything):
        return index.documents.select("doc_id", F.lit(1.0).alias("score"))
    if isinstance(q, Nothing):
        return index.documents.filter(F.lit(False)).select("doc_id", F.lit(1.0).alias("score"))
    assert isinstance(q, Bool)
    kinds = {"must": q.must, "should": q.should, "not": q.must_not, "filter": q.filters}
    parts: list[DataFrame] = []
    terms: dict[str, list[tuple[str, int]]] = {}
    for kind, clauses in kinds.items():
        for k, c in enumerate(clauses):
            if isinstance(c, Term):
                terms.setdefault(c.text, []).append((kind, k))
            else:
                parts.append(_plan(c, index, stats).select("doc_id", F.lit(kind).alias("kind"), F.lit(k).alias("k"), "score"))
    if terms:
        uses = F.coalesce(*[F.when(F.col("term") == w, F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("k")) for a, b in u])) for w, u in terms.items()])
        rows = _terms(index, sorted(terms), stats)
        parts.append(rows.select("doc_id", F.explode(uses).alias("u"), "score").select("doc_id", "u.kind", "u.k", "score"))
    every = reduce(DataFrame.unionByName, parts)
    n = lambda kind: F.size(F.collect_set(F.when(F.col("kind") == kind, F.col("k"))))
    score = F.coalesce(F.sum(F.when(F.col("kind").isin("must", "should"), F.col("score"))), F.lit(0.0))
    found = every.groupBy("doc_id").agg(n("must").alias("m"), n("filter").alias("f"), n("not").alias("x"), n("should").alias("s"), score.alias("score"))
    ok = (F.col("m") == len(q.must)) & (F.col("f") == len(q.filters)) & (F.col("x") == 0)
    return found.filter(ok if q.must or q.filters else ok & (F.col("s") > 0)).select("doc_id", "score")


def _phrase(q: Phrase, index: Index, stats: Statistics) -> DataFrame:
    words = list(dict.fromkeys(q.words))
    rows = index.postings(F.col("term").isin(*words)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p"), F.first("dl").alias("dl"))
    rows = rows.filter(F.size("p") == len(words))
    places = F.array(*[F.element_at("p", w) for w in q.words[1:]])
    end = lambda start: F.aggregate(places, start, lambda at, own: F.array_min(F.filter(own, lambda x: x > at)))
    if q.slop:
        fits = lambda x: F.coalesce(end(x) - x - (len(q.words) - 1) <= q.slop, F.lit(False))
    else:
        fits = lambda x: reduce(lambda a, b: a & b, [F.array_contains(F.element_at("p", w), x + k) for k, w in enumerate(q.words) if k])
    tf = F.size(F.filter(F.element_at("p", q.words[0]), fits))
    found = rows.withColumn("tf", tf).filter("tf > 0")
    weights = [stats.weight(F.col("tf"), F.col("dl"), F.lit(stats.df.get(w, 0))) for w in q.words]
    return found.select("doc_id", reduce(lambda a, b: a + b, weights).alias("score"))
