"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at a document's counts and votes good (1), votes poor (0) or abstains (null).
Rules differ in accuracy: expectation-maximisation over how often each pattern of votes occurs
(3 to the power of the number of rules patterns at most, counted over all documents) estimates
how often each rule casts which vote on good and on poor documents, and the share of good ones; a document is then
kept by its posterior probability of being good, not by passing every rule. Hard floors may fail
a document before any vote.

Defined cases: null and empty texts have no words and fail the floor; an empty table gives no
rows; without votes the posterior is the prior; rows are independent but for the estimates, so
repeated rows get equal results. The input's other columns are kept; those named like an output
column are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a run of `width` words that the text holds twice or more.

    Runs are compared by the 64-bit hashes of their words, sorted with their places, so the work
    grows as n log n in the words of one text; texts without any repeated run skip the sort.
    """

    def runs(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)])))

    def covered(r: Column) -> Column:
        places = let(
            F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when(F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"])), lambda i: i.isNotNull()
            ),
        )
        last = let(
            F.sort_array(places),
            lambda p: F.aggregate(p, F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")), lambda a: a["n"]),
        )
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(last)

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(let(runs(w), covered)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns with the counts that rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    found = free("_found", docs)
    counted = docs.withColumns({
        found: let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))),
        "word_chars": size(r"[\x20\x09-\x0D]+"),
        "n_symbols": size(r"[^#*$%&|<>]+"),
        "n_upper": size(r"[^A-Z]+"),
        "n_letters": size(r"\P{L}+"),
        "n_lone_marks": F.regexp_count(text, F.lit(r"(?<=^|\s)[#*$%&|<>](?=\s|$)")).cast("long"),
        "n_marks": size(r"[^!?]+"),
        "n_dup_lines": duplicate_lines(text),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
    })
    return counted.withColumns({"n_words": F.col(found)["n_words"], "n_repeat_words": F.col(found)["n_repeat_words"]}).drop(found)


def free(name: str, docs: DataFrame) -> str:
    """The name, longer where the table has a column that begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def rules() -> dict[str, Column]:
    """Votes by name: true for good, false for poor, null to abstain."""
    n, c = F.col, F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))

    def vote(poor: Column, good: Column | None = None) -> Column:
        out = F.when(poor, F.lit(False))
        return out if good is None else out.when(good, F.lit(True))

    return {
        "length": vote(n("n_words") < 50, n("n_words") >= 100),
        "word_length": vote((c < 2.5 * words) | (c > 14 * words), (c >= 4 * words) & (c <= 9 * words)),
        "symbols": vote(n("n_symbols") * 10 > words, n("n_symbols") == 0),
        "letters": vote(n("n_letters") * 100 < c * 80, n("n_letters") * 100 >= c * 92),
        "lone_marks": vote(n("n_lone_marks") * 10 > words),
        "repeats": vote(n("n_repeat_words") * 10 > words * 3, n("n_repeat_words") == 0),
        "lines": vote(n("n_dup_lines") * 10 > n("n_lines") * 3),
        "capitals": vote(n("n_upper") * 10 > c * 3),
        "marks": vote(n("n_marks") * 5 > words),
    }


#: Share of good documents before any vote is seen, and how often a rule votes good and poor on good and on poor
#: documents: the start, and what few counts lean to with the weight of so many documents of each kind.
PRIOR, ON_GOOD, ON_POOR, WEIGHT = 0.8, (0.6, 0.02), (0.2, 0.5), 20.0

#: For a rule: what a vote for good and a vote for poor add to the log odds of a good document.
Weights = tuple[float, float]


def estimate(patterns: list[tuple[tuple[bool | None, ...], int]], rounds: int = 100) -> tuple[float, list[Weights]]:
    """Share of good documents and each rule's weights, by expectation-maximisation.

    Documents with equal votes count together. Abstaining says nothing; a vote never counts for
    its opposite, so the two classes keep their meaning.
    """
    k = len(patterns[0][0]) if patterns else 0
    weigh = lambda good, poor: (max(math.log(good[0] / poor[0]), 0.0), min(math.log(good[1] / poor[1]), 0.0))
    prior, weights = PRIOR, [weigh(ON_GOOD, ON_POOR)] * k
    for _ in range(rounds):
        of = [0.0, 0.0]
        cast = [[[x * WEIGHT for x in ON_GOOD], [x * WEIGHT for x in ON_POOR]] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(prior, weights, votes)
            for j, share in enumerate((n * p, n * (1 - p))):
                of[j] += share
                for i, v in enumerate(votes):
                    if v is not None:
                        cast[i][j][0 if v else 1] += share
        rate = [[[x / (of[j] + WEIGHT) for x in cast[i][j]] for j in range(2)] for i in range(k)]
        new = [weigh(*r) for r in rate]
        share = min(max((of[0] + PRIOR * WEIGHT) / (sum(of) + WEIGHT), 0.05), 0.95)
        moved = max([abs(share - prior), *(abs(a - b) for x, y in zip(new, weights, strict=True) for a, b in zip(x, y, strict=True))])
        prior, weights = share, new
        if moved < 1e-6:
            break
    return prior, weights


def posterior(prior: float, weights: list[Weights], votes) -> float:
    """Probability of good given the votes, taken as independent."""
    z = math.log(prior / (1 - prior)) + sum(0.0 if v is None else w[0] if v else w[1] for w, v in zip(weights, votes, strict=True))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, text_col: str = "text", least: float = 0.5, counts: DataFrame | None = None) -> DataFrame:
    """All columns with the counts, base_failed, posterior and kept."""
    votes = rules()
    counted = counts if counts is not None else measure(docs, text_col)
    mark = free("_vote", counted)
    names = [f"{mark}_{k}" for k in votes]
    voted = counted.withColumns(dict(zip(names, votes.values(), strict=True)))
    patterns = voted.groupBy(*names).count().collect()  # 3 ** len(rules) rows at most
    prior, weights = estimate(sorted([(tuple(r[n] for n in names), r["count"]) for r in patterns], key=repr))
    terms = [F.when(F.col(n), F.lit(good)).when(~F.col(n), F.lit(poor)).otherwise(F.lit(0.0)) for n, (good, poor) in zip(names, weights, strict=False)]
    z = reduce(lambda a, b: a + b, terms, F.lit(math.log(prior / (1 - prior))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-z))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*names)
