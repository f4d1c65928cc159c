"""Dictionary terms in token sequences, as a Spark job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.plans.query import Glossary, SynonymTerm, Synonyms

#: Bytes of terms that may travel with the code.
MOST_BYTES = 8 << 20


def dictionary_hits(docs: DataFrame, terms: list[tuple[str, ...]], prefixes: list[str] = ()) -> DataFrame:
    """(doc_id, first, n, term): the longest term at each place, from left to right without overlap.

    Only documents that hold a first token or a prefix reach Python; the test for that stays in the JVM.
    """
    if sum(len(w) for t in terms for w in t) > MOST_BYTES:
        raise ValueError("too many terms to send to each task")
    glossary = Glossary([Synonyms(tuple(SynonymTerm(t) for t in terms) + tuple(SynonymTerm((p,), True) for p in prefixes))])
    firsts = sorted({t[0] for t in terms})
    some = F.arrays_overlap("tokens", F.array(*map(F.lit, firsts))) if firsts else F.lit(False)
    for p in prefixes:
        some = some | F.exists("tokens", lambda t, p=p: t.startswith(p))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, a, b - a, " ".join(t.tokens)) for d, tokens in zip(pdf["doc_id"], pdf["tokens"], strict=True) for a, b, t, _ in glossary.hits(list(tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "first", "n", "term"])

    return docs.filter(some).select("doc_id", "tokens").mapInPandas(find, "doc_id long, first long, n long, term string")
