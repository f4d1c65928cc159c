"""URL filters: association rules mined from labelled urls, matched by an inverted index.

Urls become sets of tokens (host, its parent domains, path segments without their numbers, query
keys, file ending, fragment). Spark's FP-growth finds token combinations that stand together in
bad urls; their confidence comes from all labelled urls, by an inverted index. Rules below the
support, confidence and lift wanted go (confidence counts at the lower end of its 95 % interval,
so that a few rows prove nothing), and so do rules that hold a smaller rule of at least their
confidence. A rule fits a url that has all its tokens: rules are looked up by their rarest token.

Combinations are bounded without losing rules of MOST_TOKENS tokens or fewer. Tokens that too few
bad urls have can't be in a rule. Tokens that stand in the same labelled urls (a long template's
segments) are one item, and a rule asks for any one of them. A url of more than BLOCK * MOST_TOKENS
items is dealt to FP-growth in parts that together hold all its combinations of that size; as
parts overlap, what FP-growth finds are candidates, which are counted exactly afterwards. Equal
token sets are one row with a number; FP-growth gets each as often as the least count at most,
which changes no combination's being frequent.

A list of fixed rules (host and path prefix) comes first; the longest that fits decides. What they
decide is never learned from: labels are those of the pages' documents.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule and no
tokens, and is allowed; no labelled urls, or none mined, means that all others are allowed; ties
among fixed rules of equal length go to the one that sorts first; repeated rows are each judged.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.session import ascii_lower, cut

#: Verdict by host and path prefix.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Share of labelled urls that must hold the combination and be bad, and their least number (three can't reach a lower bound of one half).
SUPPORT, LEAST_COUNT = 0.002, 4
CONFIDENCE = 0.5
LIFT = 1.5
#: Tokens of a rule, and items of a part of a long url for each of them.
MOST_TOKENS, BLOCK = 3, 4
#: Rules whose index may be broadcast (some hundred bytes each).
MOST_SENT = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """A url's distinct tokens; numbers in path segments are one and the same."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.concat(F.lit("in="), F.array_join(F.slice(labels, k, F.size(labels)), ".")))).otherwise(F.array())
    segments = F.transform(F.filter(F.split(ascii_lower(path), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, r"\d+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.split(s, "=")[0]))
    ending = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    rest = F.filter(F.array(F.when(host != "", F.concat(F.lit("host="), host)), F.when(ending != "", F.concat(F.lit("ending="), ending)), F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment"))), lambda x: x.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(rest, parents, segments, keys)))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least_count: int = LEAST_COUNT, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Rules (rule_tokens, confidence, support): token combinations whose urls are bad.

    rule_tokens is an array of arrays, the rarest first: a url must have one token at least of each.
    """
    empty = labelled.sparkSession.createDataFrame([], "rule_tokens array<array<string>>, confidence double, support double")
    sets = cut(labelled.filter(F.col(bad_col).isNotNull()).groupBy(F.array_sort(tokens(F.col(url_col))).alias("t"), F.col(bad_col).alias("bad")).agg(F.count("*").alias("n")))
    n_bad = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))
    all_, bad = sets.agg(F.sum("n"), n_bad).first()
    if not bad:
        return empty
    least = max(least_count, -int(-support * all_ // 1))
    items = cut(_items(sets, least))
    rows = _as_items(sets, items)
    candidates = cut(_candidates(rows.filter("bad"), least, most_tokens))
    counted = _counted(candidates, rows, items).filter(F.col("bad") >= least)
    p, n, z = F.col("bad") / F.col("all"), F.col("all"), 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    good = (low >= confidence) & (p / (bad / all_) >= lift) & (F.col("bad") / all_ >= support)
    rules = cut(counted.filter(good).select("rule", p.alias("confidence"), (F.col("bad") / all_).alias("support")))
    # a rule's proper parts (six at most for three tokens) are looked up among the rules
    parts = F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), most_tokens) - 2), lambda m: F.filter("rule", lambda _, i: F.getbit(m, i) == 1))
    parts = rules.select("rule", F.col("confidence").alias("own"), F.explode(F.array_distinct(F.filter(parts, lambda x: (F.size(x) > 0) & (F.size(x) < F.size("rule"))))).alias("part"))
    covered = parts.join(rules.select(F.col("rule").alias("part"), "confidence"), "part").filter("confidence >= own").select("rule").distinct()
    kept = rules.join(covered, "rule", "left_anti").select("rule", "confidence", "support", F.explode("rule").alias("item")).join(items.groupBy("item").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("token")).alias("any")), "item")
    return cut(kept.groupBy("rule", "confidence", "support").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "any"))), lambda x: x["any"]).alias("rule_tokens")).select("rule_tokens", "confidence", "support"))


def _items(sets: DataFrame, least: int) -> DataFrame:
    """token, item and n (urls with it) of the tokens that enough bad urls have; tokens of the same urls are one item, named by the first."""
    h = F.xxhash64("t", "bad")
    each = sets.select("n", "bad", h.alias("h"), F.explode("t").alias("token"))
    own = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n"))).alias("n_bad"), F.count("*").alias("k"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("h")).alias("x")).filter(F.col("n_bad") >= least)
    first = own.groupBy("k", "s", "x").agg(F.min("token").alias("item"))
    return own.join(first, ["k", "s", "x"]).select("token", "item", "n")


def _as_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct sets of items (items, bad, n)."""
    each = sets.select("t", "bad", "n", F.explode("t").alias("token")).join(items.select("token", "item"), "token")
    own = each.groupBy("t", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("n").alias("n"))
    return cut(own.groupBy("items", "bad").agg(F.sum("n").alias("n")))


def _candidates(rows: DataFrame, least: int, most_tokens: int) -> DataFrame:
    """Combinations (rule) of most_tokens items at most that may stand in so many bad urls."""
    wide = F.size("items") > BLOCK * most_tokens
    parts = rows.filter(wide).select("items", "n", F.lit(-1).alias("b0"), F.array().cast("array<string>").alias("part"))
    blocks = F.ceil(F.size("items") / BLOCK).cast("int")
    for k in range(most_tokens):  # all choices of so many blocks
        after = parts.select("items", "n", "part", F.explode(F.sequence(F.col("b0") + 1, blocks - most_tokens + k)).alias("b0"))
        parts = after.select("items", "n", "b0", F.concat("part", F.slice("items", F.col("b0") * BLOCK + 1, F.lit(BLOCK))).alias("part"))
    rows = rows.filter(~wide).select("items", "n").union(parts.select("part", "n")).withColumn("n", F.least("n", F.lit(least)))
    rows = rows.select("items", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024))).alias("k"))  # as often as it counts, in arrays of bounded size
    rows = cut(rows.select("items", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("k") * 1024, F.lit(1024)))).alias("i")).select("items"))
    n = rows.count()
    if not n:
        return rows.select(F.col("items").alias("rule"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(rows).freqItemsets
    return found.filter(F.size("items") <= most_tokens).select(F.array_sort("items").alias("rule"))


def _counted(candidates: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with the number of urls that hold them: all, and bad ones; looked up by their rarest item."""
    sizes = items.groupBy("item").agg(F.first("n").alias("n"))
    keyed = candidates.select("rule", F.explode("rule").alias("item")).join(sizes, "item").groupBy("rule").agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    held = rows.select("items", "bad", "n", F.explode("items").alias("item")).join(keyed, "item").filter(F.size(F.array_except("rule", "items")) == 0)
    return held.groupBy("rule").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None) -> DataFrame:
    """id_col, host, path, rule, verdict and the number of mined rules that fit, for every row."""
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url")).select("_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    index = mined.select(F.col("rule_tokens").alias("_rule"), F.explode(F.col("rule_tokens")[0]).alias("token"))
    index = F.broadcast(index) if index.count() <= MOST_SENT else index
    urls = rows.select("_url").filter(F.col("host") != "").distinct().select("_url", tokens(F.col("_url")).alias("_tokens"))
    held = urls.select("_url", "_tokens", F.explode("_tokens").alias("token")).join(index, "token").filter(F.forall("_rule", lambda any_: F.arrays_overlap(any_, "_tokens")))
    fits = held.groupBy("_url").agg(F.count_distinct("_rule").alias("n_mined"))
    rule = fixed_rule(F.col("host"), F.col("path"), rules)
    fixed = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()]) if rules else F.lit(None).cast("string")
    out = rows.join(fits, "_url", "left").withColumn("rule", rule)
    verdict = F.coalesce(fixed, F.when(F.col("n_mined") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("n_mined", F.lit(0).cast("long")).alias("n_mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with a label (url, bad): those whose document has one; toxic or poor documents are bad.

    The first path segment that is a number, with or without an ending, is the id of the document that the page shows.
    """
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/(\d{1,18})(?:[/.?#]|$)", 1)
    own = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return own.join(marks, "doc_id").select("url", "bad")
