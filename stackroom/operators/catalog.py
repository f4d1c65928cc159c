"""Relational operators around an archive: listings, progress, joins, revisions and index upkeep.

All are lazy DataFrame plans. Sides that are small by nature (enumerations, id sets of a scope) are
left to the planner, which broadcasts them when their size allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackroom.functions.text import extension, like_pattern
from stackroom.operators.images import FIRST_ORDINAL as FIRST_PICTURE
from stackroom.session import cut

#: A document's states.
STATUSES = ["QUEUED", "DETECTING", "EXTRACTING", "OCR", "CORRECTING", "CHUNKING", "EMBEDDING", "INDEXING", "COMPLETE", "COMPLETE_WITH_WARNINGS", "NEEDS_REVIEW", "NEEDS_TOOL", "FAILED"]
RETRY_STATUSES = ["COMPLETE_WITH_WARNINGS", "NEEDS_TOOL", "FAILED"]
SENSITIVE_FIELDS = ["password", "token", "authorization", "api_key", "apikey", "secret", "cookie"]
LEVELS = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4}


@dataclass(frozen=True)
class Filters:
    """What a listing or search is narrowed to; blank values are absent."""

    collection: str | None = None
    media_types: tuple[str, ...] = ()
    name_contains: str | None = None
    about_contains: str | None = None
    since: str | None = None
    until: str | None = None
    statuses: tuple[str, ...] = ()
    ocr_only: bool = False

    def normalized(self) -> Filters:
        """Blank to absent, dates to instants (an until date is its whole day), reversed bounds refused."""
        clean = lambda s: s.strip() or None if s else None
        low, high = _bound(clean(self.since), False), _bound(clean(self.until), True)
        if low and high and low > high:
            raise ValueError("the date range is reversed")
        return Filters(clean(self.collection), tuple(filter(None, map(clean, self.media_types))), clean(self.name_contains), clean(self.about_contains), low, high, tuple(self.statuses), self.ocr_only)


def _bound(text: str | None, upper: bool) -> str | None:
    """An ISO date or instant as UTC text of milliseconds; lower bounds round up, upper ones down."""
    if text is None:
        return None
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        at = datetime.fromisoformat(text).replace(tzinfo=UTC) + (timedelta(days=1, milliseconds=-1) if upper else timedelta())
    else:
        at = datetime.fromisoformat(text).astimezone(UTC)
        rest = at.microsecond % 1000
        at += timedelta(microseconds=0 if not rest else -rest if upper else 1000 - rest)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def iso_millis(ts: Column) -> Column:
    """UTC text of fixed width, so that text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def find_documents(docs: DataFrame, filters: Filters, ocr_units: DataFrame | None = None) -> DataFrame:
    """Documents that meet all criteria; ocr_units (doc_id) are asked only for ocr_only."""
    f = filters.normalized()
    out = docs
    if f.collection:
        out = out.filter(F.col("collection") == f.collection)
    if f.media_types:
        out = out.filter(F.col("media_type").isin(*f.media_types))
    if f.name_contains:
        p = like_pattern(f.name_contains)
        out = out.filter(F.col("filename").ilike(p) | F.col("path").ilike(p))
    if f.about_contains:
        p = like_pattern(f.about_contains)
        out = out.filter(F.coalesce(F.col("title").ilike(p), F.lit(False)) | F.coalesce(F.col("author").ilike(p), F.lit(False)) | F.coalesce(F.col("lang").ilike(p), F.lit(False)))
    if f.since:
        out = out.filter(iso_millis(F.col("created_at")) >= f.since)
    if f.until:
        out = out.filter(iso_millis(F.col("created_at")) <= f.until)
    if f.statuses:
        out = out.filter(F.col("status").isin(*f.statuses))
    return out.join(ocr_units.select("doc_id").distinct(), "doc_id", "left_semi") if f.ocr_only else out


def in_scope(rows: DataFrame, ids: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Rows of a scope's documents. No set of ids means no filter; an empty one is the caller's early return."""
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def enumeration(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, rank int")


def counts_with_zeros(docs: DataFrame, by: str, values: list[str]) -> DataFrame:
    """A count for each value of an enumeration, zero where there is none."""
    counted = docs.groupBy(by).agg(F.count("*").alias("n"))
    return enumeration(docs.sparkSession, by, values).join(counted, by, "left").select(by, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def sorted_documents(docs: DataFrame, how: str) -> DataFrame:
    """NEWEST, OLDEST, NAME_ASC or NAME_DESC, ties by id; names without regard to case."""
    name = F.expr("filename COLLATE UNICODE_CI")
    key = {"NEWEST": F.col("created_at").desc(), "OLDEST": F.col("created_at").asc(), "NAME_ASC": name.asc(), "NAME_DESC": name.desc()}[how]
    return docs.orderBy(key, F.col("doc_id").asc())


def first_by(rows: DataFrame, keys: list[str], order: str, value: str, latest: bool = False) -> DataFrame:
    """The value of each key's first (or last) row in an order without ties: a partial aggregate, no window."""
    pick = F.max_by if latest else F.min_by
    return rows.groupBy(*keys).agg(pick(value, order).alias(value))


def keep_last_write(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: for each key the row of the highest version."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_by_document(index: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the replaced documents go, the new ones come."""
    return index.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def neighbours(units: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return units.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w)})


def page_changes(pages: DataFrame, parents: DataFrame) -> DataFrame:
    """For each document: pages unchanged, changed, added and removed against the parent reading."""
    both = pages.select("doc_id", "ordinal", F.col("sha").alias("now")).join(parents.select("doc_id", "ordinal", F.col("sha").alias("then")), ["doc_id", "ordinal"], "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.groupBy("doc_id").agg(
        n(F.col("now") == F.col("then")).alias("unchanged"), n((F.col("now") != F.col("then"))).alias("changed"), n(F.col("then").isNull()).alias("added"), n(F.col("now").isNull()).alias("removed")
    )


def page_change_kinds(pages: DataFrame, parents: DataFrame, reviews: DataFrame, revisions: DataFrame) -> DataFrame:
    """For each document's revision how many pages are unchanged, added, changed (automatic, manual or unknown), restored and not published.

    pages and parents: doc_id, unit_id, ordinal, sha, approved; parents are the pages of the revision that was there
    before. revisions: doc_id, parent, restores. reviews: doc_id, unit_id, ordinal, baseline, candidate, disposition, seq: a
    decision on a candidate text, taken against a baseline revision. Who changed a page says the latest
    decision against the parent whose candidate is the page's text: APPROVE was automatic, anything else a person; decisions on
    other texts only mean a person, too, and none at all that it isn't known. Pictures are no pages.
    """
    page = ["doc_id", "unit_id", "ordinal"]
    text = F.col("ordinal") < FIRST_PICTURE
    before = parents.filter(F.col("approved") & text).select(*page, F.col("sha").alias("before")).dropDuplicates(page)
    against = reviews.join(revisions.select("doc_id", F.col("parent").alias("baseline")), ["doc_id", "baseline"])
    latest = against.groupBy(*page, F.col("candidate").alias("sha")).agg(F.max_by("disposition", "seq").alias("fitting"))
    some = against.select(*page, F.lit(True).alias("decided")).distinct()
    own = pages.filter(text).join(revisions.select("doc_id", "restores"), "doc_id", "left").join(before, page, "left").join(latest, [*page, "sha"], "left").join(some, page, "left")
    kind = (
        F.when(~F.coalesce("approved", F.lit(False)), "not_published").when(F.col("before").isNull(), "added").when(F.col("before") == F.col("sha"), "unchanged").when(F.coalesce("restores", F.lit(False)), "restored")
        .when(F.col("fitting") == "APPROVE", "automatic").when(F.col("decided"), "manual").otherwise("unknown")
    )
    kinds = ("unchanged", "added", "automatic", "manual", "unknown", "restored", "not_published")
    return own.withColumn("kind", kind).groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def places(rows: DataFrame, *order) -> DataFrame:
    """All columns with place: 1, 2, 3 ... by this order, without one task that sees all rows.

    Rows are dealt out by ranges and sorted there; a row's place is that within its range and the number of rows in the ranges before.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    mine = cut(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = {r["_part"]: r["count"] for r in mine.groupBy("_part").count().collect()}  # a row for each range
    starts = list(accumulate((counts.get(k, 0) for k in range(max(counts, default=0) + 1)), initial=0))
    return mine.withColumn("place", F.get(F.array(*map(F.lit, starts)), F.col("_part")) + F.col("_at") + 1).drop("_part", "_at")


def stale_documents(docs: DataFrame, chunks: DataFrame, index: DataFrame, fingerprint: str) -> DataFrame:
    """Documents whose rows must be rebuilt: chunked by other rules, or with another number of rows than chunks."""
    expected = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    present = index.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    joined = docs.join(expected, "doc_id", "left").join(present, "doc_id", "left").na.fill(0, ["n_chunks", "n_rows"])
    return joined.filter(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)) | (F.col("n_chunks") != F.col("n_rows"))).select("doc_id", "n_chunks", "n_rows")


def redact(fields: Column) -> Column:
    """Values of sensitive names replaced in a map."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SENSITIVE_FIELDS), F.lit("[redacted]")).otherwise(v))


def admitted(names: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Extension filter: one of include and exclude at most."""
    if include and exclude:
        raise ValueError("include and exclude can't both be given")
    own = extension(names)
    return own.isin(*include) if include else ~own.isin(*exclude) if exclude else F.lit(True)


def ignore_rules(patterns: list[str]) -> list[tuple[str, bool, bool]]:
    """Ignore patterns as (regular expression over a whole path, for directories only, negated)."""
    out = []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        only_dir = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        body, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("/**", i) and i + 3 == len(p):
                body, i = body + "/.+", i + 3
            elif p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                i += p[i] == "\\" and i + 1 < len(p)
                body, i = body + re.sub(r"([^\w\s/])", r"\\\1", p[i]), i + 1
        out.append((f"(?i)^{'' if anchored else '(?:.*/)?'}{body}$", only_dir, negated))
    return out


def ignored(path: Column, is_dir: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the last pattern that fits decides, and an ignored parent decides for all below it."""
    rules = ignore_rules(patterns)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("p"), ((k < F.size(parts)) | is_dir).alias("dir")))

    def verdict(x: Column) -> Column:
        out = None
        for regex, only_dir, negated in reversed(rules):
            fits = x["p"].rlike(regex) & (x["dir"] if only_dir else F.lit(True))
            out = F.when(fits, F.lit(not negated)) if out is None else out.when(fits, F.lit(not negated))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    return F.exists(prefixes, verdict)


def log_records(records: DataFrame, least: str = "TRACE", job: str | None = None, component: str | None = None, since: str | None = None) -> DataFrame:
    """Log records at or above a level, by job, component and time, in order of time."""
    rank = F.coalesce(*[F.when(F.upper("level") == k, F.lit(v)) for k, v in LEVELS.items()])
    out = records.filter(rank >= LEVELS[least])
    for column, wanted in (("job", job), ("component", component)):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    if since is not None:
        out = out.filter(F.col("timestamp") >= since)
    return out.orderBy("timestamp")


def attempts_in_window(events: DataFrame, who: str, ts: str = "ts", minutes: int = 15, most: int = 10) -> DataFrame:
    """Sliding limit: earlier events of the same key in the last minutes (one exactly that old has left), and whether this one is refused."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(who).orderBy(micros).rangeBetween(-(minutes * 60_000_000 - 1), -1)
    counted = events.withColumn("earlier", F.count("*").over(w))
    return counted.withColumn("refused", F.col("earlier") >= most)


def prune_to_fit(turns: DataFrame, budget: int, keep_first: int = 2) -> DataFrame:
    """The newest turns of each conversation whose sizes fit, besides its first ones, which always stay."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    head = F.sum(F.when(F.col("turn") < keep_first, F.col("size")).otherwise(0)).over(Window.partitionBy("conv_id"))
    tail = F.sum(F.when(F.col("turn") >= keep_first, F.col("size")).otherwise(0)).over(w)
    return turns.withColumns({"head": head, "tail": tail}).filter((F.col("turn") < keep_first) | (F.col("head") + F.col("tail") <= budget)).drop("head", "tail")


#: Failure codes that a missing tool causes.
TOOL_CODES = ["NEEDS_TOOL", "NEEDS_TESSERACT", "NEEDS_SURYA", "NEEDS_LLAMA_CPP", "NEEDS_SURYA_MODEL", "SURYA_START_FAILED"]


def failure_status(code: Column) -> Column:
    """The state of a document that failed with this code: waiting for a tool, or failed."""
    return F.when(code.isin(*TOOL_CODES), "NEEDS_TOOL").otherwise("FAILED")


def page_census(pages: DataFrame, selected: str | list[int] = "automatic", reads_images: bool = True) -> DataFrame:
    """doc_id, document_pages and pages_to_read of a rescan. pages: doc_id, page (from 0), published (its text or null), policy (whether its text can't be trusted).

    Automatically a page is read that the policy says, or that has no published text; `all` reads
    every page, a list just those. Without a reader of images none is read.
    """
    wanted = F.lit(True) if selected == "all" else F.col("page").isin(*selected) if isinstance(selected, list) else F.col("published").isNull() | F.coalesce("policy", F.lit(True))
    return pages.groupBy("doc_id").agg(F.count("*").alias("document_pages"), F.count_if(wanted & F.lit(reads_images)).alias("pages_to_read"))


#: Units to each side of one that is read, and hits of one search.
MOST_AROUND, MOST_HITS = 5, 10


def units_around(units: DataFrame, asked: DataFrame, before: int = MOST_AROUND, after: int = MOST_AROUND) -> DataFrame:
    """For each unit asked for (doc_id, ordinal): it and its neighbours, with at (their place from it); up to MOST_AROUND to each side.

    Places are counted over the units that are there, not by their numbers.
    """
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    placed = units.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("place", F.row_number().over(w))
    centre = placed.join(asked.select("doc_id", "ordinal").distinct(), ["doc_id", "ordinal"]).select("doc_id", F.col("ordinal").alias("asked"), F.explode(F.sequence(F.col("place") - min(before, MOST_AROUND), F.col("place") + min(after, MOST_AROUND))).alias("place"), F.col("place").alias("centre"))
    return centre.join(placed, ["doc_id", "place"]).withColumn("at", F.col("place") - F.col("centre")).drop("place", "centre")


def structure_listing(units: DataFrame, text: str = "text", chars: int = 80) -> DataFrame:
    """doc_id, n_units, first and last ordinal, and the units' beginnings that are headings (ordinal, label), in order."""
    title = F.regexp_extract(F.col(text), r"^\s*#{1,6}\s+(.*)$", 1)
    found = F.collect_list(F.when(title != "", F.struct(F.col("ordinal").alias("ordinal"), F.substring(title, 1, chars).alias("label"))))
    return units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sort_array(found).alias("headings"))
