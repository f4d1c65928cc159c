"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is its words (lower-cased) with their counts. Each of SAMPLES samples picks one word of a
text in proportion to its count, and alike for texts that share it: for a word k with count S, hashes
of (k, sample) give r and c from a gamma distribution of shape 2 and b from a uniform one;
t = floor(ln S / r + b), and the sample is the word with the smallest ln c - r (t + 1 - b). That number
names the word and its t, so two texts' samples are equal with the probability of their generalised
Jaccard similarity: the sum of the lesser counts over that of the greater. A fingerprint holds 16
bits of each sample as four hexadecimal digits; likeness() is the share of equal ones.

All work on a text happens where it lies: rows are dealt out once, by a bucket, and words are counted,
equal (word, count) pairs of a bucket get their samples worked out once, and minima are taken within the
bucket, without another shuffle. Buckets hold a bounded share of the rows: of copies, one stands for
all in fingerprints(); neighbours() cuts the order of ids at quantiles, and each of those ranges evenly.

Defined cases: null and empty texts, and those of white space, have the fingerprint "", like one another's (1) and unlike
any other's (0); equal texts have equal fingerprints; a null id comes after all others, in the order of a hash of the text, as
do rows that share an id among themselves; the last row's neighbour is the first, a single row's is itself; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.session import cut

SAMPLES = 64
#: A word is a run of anything but ASCII white space (Java's own class for it is the quickest).
WORD, GAP = r"\S+", r"\s"
#: Ranges of equal numbers of ids, and buckets for each shuffle partition.
RANGES, EACH = 16, 2
#: First rows of buckets that may be broadcast (some 30 bytes each).
MOST_SENT = 200_000


def _samples(term: Column, n: Column, samples: int) -> Column:
    """For each sample the number that names the word with its count, and is the smallest for the word that is picked."""
    share = lambda h, low, bits: (F.shiftrightunsigned(h, low).bitwiseAND((1 << bits) - 1) + 0.5) / float(1 << bits)
    ln_s = F.log(n.cast("double"))

    def one(j: int) -> Column:
        h1, h2 = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
        c = -F.log(share(h1, 32, 32) * share(h1, 0, 32))
        r, b = -F.log(share(h2, 42, 22) * share(h2, 20, 22)), share(h2, 0, 20)
        return F.log(c) - r * (F.floor(ln_s / r + b) + 1 - b)

    return F.array(*[one(j) for j in range(samples)])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sign(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """bucket, row, fingerprint for rows (bucket, row, text); (bucket, row) must tell rows apart, and buckets be of bounded size."""
    words = rows.select("bucket", "row", F.explode(F.concat(F.array(F.lit(None).cast("string")), _words(F.coalesce("text", F.lit(""))))).alias("word"))
    counted = words.groupBy("bucket", "row", _term()).agg(F.count("*").alias("n"))
    return _signed(counted, samples)


def _term() -> Column:
    """A lower-cased word's hash (short ASCII words are lower-cased much sooner than whole texts); null for the head that stands before each text's words, so that no text is lost."""
    return F.when(F.col("word").isNotNull(), F.xxhash64(F.lower("word"))).alias("term")


def _signed(counted: DataFrame, samples: int, rows_of=None) -> DataFrame:
    """bucket, row, fingerprint from counts (bucket, row, term, n); rows_of turns a row's number into those of the rows whose texts hold all its words."""
    shared = counted.groupBy("bucket", "term", "n").agg(F.collect_list("row").alias("rows"))
    # a lambda function beside the samples keeps them out of the stage's one method, which would be too long to be compiled
    values = shared.select("bucket", F.transform("rows", lambda r: r).alias("rows"), F.when(F.col("term").isNotNull(), _samples(F.col("term"), F.col("n"), samples)).alias("v")).select("bucket", "v", F.explode("rows").alias("row"))
    names = [f"s{j}" for j in range(samples)]
    least = values.groupBy("bucket", "row").agg(*[F.min(F.get("v", F.lit(j))).alias(s) for j, s in enumerate(names)])
    if rows_of:
        least = least.select("bucket", F.explode(rows_of(F.col("row"))).alias("row"), *names).groupBy("bucket", "row").agg(*[F.min(s).alias(s) for s in names])
    digits = lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(0xFFFF)), 4, "0")
    return least.select("bucket", "row", F.when(F.col("s0").isNull(), "").otherwise(F.array_join(F.transform(F.array(*names), digits), "")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints of one length; 1 for two without samples, 0 for one with and one without."""
    groups = lambda x: F.regexp_extract_all(x, F.lit(".{4}"), F.lit(0))
    equal = F.aggregate(F.zip_with(groups(a), groups(b), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    size = F.greatest(F.char_length(a), F.char_length(b)) / 4
    return F.when(size == 0, 1.0).otherwise(equal / size)


def fingerprints(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """All columns with fingerprint; a column of that name is replaced. Copies of a text are worked on once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    names = [c for c in docs.columns if c.lower() != "fingerprint"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), key.alias("row"))
    texts = docs.select(key.alias("row"), text.alias("text")).groupBy("row").agg(F.first("text").alias("text"))
    found = sign(texts.withColumn("bucket", F.pmod(F.col("row.a"), F.lit(_parts(docs)))).repartition(_parts(docs), "bucket"), samples)
    return own.join(found, "row", "left").select("own.*", "fingerprint")


def _parts(df: DataFrame) -> int:
    """Buckets, and partitions for them: several for each shuffle partition, as a bucket's words take more room than its texts."""
    return max(16, EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, row, doc_id, text, next_text: each row with the text of the next by ascending id; bucket and row tell rows apart.

    Rows with guest = 1 are copies of other buckets' first rows, with no next: they stand after a bucket's last row.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shares = [k / RANGES for k in range(RANGES)]
    top, lows = own.agg(F.max("doc_id"), F.percentile_approx("doc_id", shares, 100 * RANGES)).first()
    lows = sorted(set(lows or [0]))
    spans = [b - a for a, b in zip(lows, [*lows[1:], (top or 0) + 1], strict=True)]
    cells = -(-_parts(docs) // len(lows))
    own = own.withColumn("h", F.xxhash64("text"))
    known = F.array(*[F.lit(x).cast("long") for x in lows])
    own = own.withColumn("i", F.size(F.filter(known, lambda x: x <= F.col("doc_id"))) - 1)  # the first id may be below its approximate quantile
    at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.greatest("i", F.lit(0)))
    cell = F.greatest(F.least(F.floor((F.col("doc_id").cast("double") - at(lows)) / at(spans) * cells), F.lit(cells - 1)), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), len(lows) * cells + F.pmod("h", F.lit(cells))).otherwise(F.greatest("i", F.lit(0)) * cells + cell)
    own = own.select(bucket.cast("long").alias("bucket"), "doc_id", "h", "text")

    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    firsts = own.groupBy("bucket").agg(F.min(order).alias("x")).select("bucket", "x.doc_id", "x.h")
    alone = Window.orderBy("bucket")  # a row for each bucket
    firsts = firsts.withColumns({"before": F.lag("bucket").over(alone), "last": F.max("bucket").over(alone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    firsts = cut(firsts.select(F.col("bucket").alias("f_bucket"), F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), F.coalesce("before", "last").alias("to")))
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_SENT else firsts
    guests = own.join(firsts, (F.col("bucket") == F.col("f_bucket")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    both = own.withColumn("guest", F.lit(0)).unionByName(guests.select(F.col("to").alias("bucket"), "doc_id", "h", "text", F.lit(1).alias("guest")))
    both = both.repartitionByRange(len(lows) * cells, "bucket")  # about a partition for each bucket
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "h")
    return both.withColumns({"row": F.row_number().over(w).cast("long"), "next_text": F.lead("text").over(w)}).select("bucket", "row", "doc_id", "text", F.when(F.col("guest") == 0, F.col("next_text")).alias("next_text"), "guest")


def edited(text: Column, next_text: Column) -> Column:
    """The text whose last half (rounded down, in code points) makes way for as many of the next one's first code points."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = neighbours(docs, id_col, text_col)
    text = F.col("text")
    changed = F.when(F.col("guest") == 0, edited(text, F.col("next_text")))
    # the words that both texts begin with are counted once: an edited text has all of the text's first half but the last one, and what follows them
    n = F.char_length(text)
    head = F.substring(text, F.lit(1), n - F.floor(n / 2).cast("int"))
    same = F.greatest(F.size(_words(head)) - 1, F.lit(0))
    last = F.regexp_extract(head, f"{WORD}{GAP}*$", 0)
    rest = F.substring(changed, F.char_length(head) - F.char_length(last) + 1, F.lit((1 << 31) - 1))
    texts = rows.select("bucket", "row", same.alias("same"), _words(text).alias("own"), _words(F.coalesce(rest, F.lit(""))).alias("rest"))
    words = texts.select("bucket", "row", "same", F.size("own").alias("n"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "own", "rest")).alias("at", "word"))
    of = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
    at = F.col("at")
    counted = words.groupBy("bucket", "row", _term()).agg(of(at <= F.col("n"))("a"), of((at <= F.col("same")) | (at > F.col("n")))("b"))
    entry = lambda n, mark: F.struct(F.col(n).alias("n"), (F.col("row") * 4 + mark).alias("row"))
    entries = F.when(F.col("a") == F.col("b"), F.array(entry("a", 3))).when(F.col("b") == 0, F.array(entry("a", 1))).when(F.col("a") == 0, F.array(entry("b", 2))).otherwise(F.array(entry("a", 1), entry("b", 2)))
    # a row's own text has an even number, its edited text the next one
    first = lambda row: F.floor(row / 4) * 2
    rows_of = lambda row: F.when(row % 4 == 3, F.array(first(row), first(row) + 1)).otherwise(F.array(first(row) + F.when(row % 4 == 2, 1).otherwise(0)))
    w = Window.partitionBy("bucket").orderBy("row")
    signed = _signed(counted.select("bucket", "term", F.inline(entries)), samples, rows_of).select("bucket", "row", "fingerprint", F.lead("fingerprint", 1).over(w).alias("edited_fingerprint"), F.lead("fingerprint", 2).over(w).alias("next_fingerprint"))
    signed = signed.filter("row % 2 = 0").withColumn("row", (F.col("row") / 2).cast("long"))
    own = rows.filter("guest = 0").select("bucket", "row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(changed, 256).alias("edited_sha256"))
    near = {f"near_{k}": likeness(F.col("fingerprint"), F.col(f"{k}_fingerprint")) for k in ("edited", "next")}
    return own.join(signed, ["bucket", "row"]).withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
