"""An index that is kept up: immutable segments of postings with tombstones, merged by size.

A batch of changes (inserted, replaced and deleted documents) becomes a segment of its own and touches
nothing that is written already:

* `postings`, sorted by term in range partitions, of the batch's documents;
* `forward`, each document's distinct terms, in folders by a hash of its id, so that what a
  change replaces is read from the few folders that its ids fall into;
* `gone`, the ids that the batch changes: a document's version in a segment lives while no later segment has its id there;
* `terms`, by how many documents each term's frequency changes: those of the batch less those replaced or deleted.

So statistics are sums over segments, and scores are those of an index built anew. A manifest, a
small table for each version, lists the segments; readers take the latest complete one, and a
segment without a manifest is never seen. It holds the number of the last batch: one that comes again changes
nothing. A new segment that is not much smaller than those before it is merged with them, which keeps
about as many segments as the logarithm of the index, and rewrites a posting about as often.
Files of merged segments stay for readers until vacuum().

Several changes of one document in a batch: the one with the greatest `version` counts (any one
where there is no such column). A null text is an empty document; a null id is left out. One writer at a time: a second one that
writes the same manifest's version fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.text import plain_tokens
from stackroom.plans.query import Index
from stackroom.session import ready, stored

#: Folders of a segment's documents, and words of a partition of postings.
FOLDERS, PARTITION_WORDS = 64, 4_000_000
#: A segment is merged with those after it while it is less than so many times as large as they are together.
RATIO = 2.0
_MANIFEST = "name string, seq long, size long, n long, words long, gone boolean, batch long"


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int
    size: int  #: postings and tombstones
    n: int  #: documents, less those that it replaces or deletes in earlier segments
    words: int  #: the same for their words
    gone: bool  #: whether it has tombstones
    batch: int | None


class Segments:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, analyze: Callable = plain_tokens, ratio: float = RATIO, partition_words: int = PARTITION_WORDS):
        self.spark, self.path, self.analyze, self.ratio, self.partition_words = ready(spark), path.rstrip("/"), analyze, ratio, partition_words

    # reading

    def segments(self) -> list[Segment]:
        """Those of the latest complete manifest, the oldest first."""
        version = self._version()
        if not version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(self._manifest(version)).collect()
        return [Segment(**r.asDict()) for r in sorted(rows, key=lambda r: r["seq"])]

    def index(self) -> Index:
        """What compile() and keyword() ask: the living postings of all segments, and their statistics."""
        own = self.segments()
        n, words = sum(s.n for s in own), sum(s.words for s in own)
        df = self._read(own, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return Index(stored=self._living(own, "postings").drop("seq"), lengths=self._living(own, "forward").select("doc_id", "dl"), vocabulary=df, totals=Row(n=n, average=words / n if n else None))

    # writing

    def apply(self, changes: DataFrame, batch: int | None = None) -> bool:
        """Take in changes (doc_id, text, optionally deleted and version); false if the batch was taken in before."""
        old = self.segments()
        last = max((s.batch for s in old if s.batch is not None), default=None)
        if batch is not None and last is not None and batch <= last:
            return False
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        rows = changes.filter(F.col("doc_id").isNotNull()).select("doc_id", F.struct(deleted.alias("deleted"), F.coalesce("text", F.lit("")).alias("text")).alias("x"), *(["version"] if "version" in changes.columns else []))
        latest = F.max_by("x", "version") if "version" in changes.columns else F.first("x")
        rows = rows.groupBy("doc_id").agg(latest.alias("x")).select("doc_id", F.col("x.deleted").alias("deleted"), self.analyze(F.col("x.text")).alias("tokens"))
        rows = stored(rows.withColumn("tokens", F.when(~F.col("deleted"), F.col("tokens"))))  # analysed once
        new = rows.filter("not deleted")
        seq, name = max((s.seq for s in old), default=0) + 1, uuid.uuid4().hex
        words = new.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
        self._write_sorted(Index(tokens=new.select("doc_id", "tokens")).places().filter("term is not null"), f"{name}/postings", words, "doc_id")  # an id has one row
        forward = new.select("doc_id", F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("terms"))
        self._write_forward(forward, name)
        self._rows(rows.select("doc_id")).write.parquet(f"{self.path}/segments/{name}/gone")

        before = self._replaced(old, rows.select("doc_id"))
        counted = forward.select("dl", "terms", F.lit(1).alias("sign")).unionByName(before.select("dl", "terms", F.lit(-1).alias("sign")))
        terms = counted.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).filter("df <> 0")
        self._write_sorted(terms, f"{name}/terms", words)
        n, words = counted.agg(F.coalesce(F.sum("sign"), F.lit(0)), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0))).first()
        size = self.spark.read.parquet(f"{self.path}/segments/{name}/postings").count() + rows.count()
        self._commit([*old, Segment(name, seq, size, n, words, bool(old), batch)])
        self._merge_tail()
        return True

    def _merge_tail(self) -> None:
        own = self.segments()
        first = len(own) - 1
        while first > 0 and own[first - 1].size < self.ratio * sum(s.size for s in own[first:]):
            first -= 1
        if first < len(own) - 1:
            self.merge(first)

    def merge(self, first: int = 0) -> None:
        """Make one segment of those from the given place on: what is dead among them goes, and all tombstones if none is older."""
        own = self.segments()
        older, merged = own[:first], own[first:]
        if len(merged) < 2:
            return
        name, words = uuid.uuid4().hex, sum(s.words for s in merged)
        self._write_sorted(self._living(merged, "postings").drop("seq"), f"{name}/postings", max(words, 0), "doc_id")
        self._write_forward(self._living(merged, "forward").select("doc_id", "dl", "terms"), name)
        gone = self._read(merged, "gone").select("doc_id").distinct()
        self._rows(gone if older else gone.limit(0)).write.parquet(f"{self.path}/segments/{name}/gone")
        self._write_sorted(self._read(merged, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), f"{name}/terms", max(words, 0))
        read = lambda part: self.spark.read.parquet(f"{self.path}/segments/{name}/{part}")
        size = read("postings").count() + read("gone").count()
        batches = [s.batch for s in merged if s.batch is not None]
        self._commit([*older, Segment(name, merged[-1].seq, size, sum(s.n for s in merged), words, bool(older), max(batches, default=None))])

    def vacuum(self) -> None:
        """Delete segments and manifests that the latest one does not need; no reader may be at work on older ones."""
        keep = {s.name for s in self.segments()}
        version = self._version()
        for name in self._list("segments"):
            if name not in keep:
                self._delete(f"{self.path}/segments/{name}")
        for name in self._list("manifests"):
            if int(name) != version:
                self._delete(f"{self.path}/manifests/{name}")

    # parts

    def _read(self, own: list[Segment], part: str) -> DataFrame:
        """Rows of a part of these segments, with their seq."""
        schema = {"postings": "term string, doc_id long, dl int, tf long, positions array<int>", "forward": "doc_id long, dl int, terms array<string>, folder int", "gone": "doc_id long", "terms": "term string, df long"}[part]
        if not own:
            return self.spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s.name}/{part}").withColumn("seq", F.lit(s.seq).cast("long")) for s in own])

    def _living(self, own: list[Segment], part: str, folders: list[int] | None = None) -> DataFrame:
        """Rows of documents that no later one of these segments replaces or deletes. Filters on terms and folders reach the files."""
        rows = self._read(own, part)
        if folders is not None:
            rows = rows.filter(F.col("folder").isin(*folders)) if folders else rows.limit(0)
        later = [s for s in own[1:] if s.gone]
        if not later:
            return rows
        gone = self._read(later, "gone").select(F.col("doc_id").alias("gone_id"), F.col("seq").alias("gone_by"))
        return rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_by")), "left_anti")

    def _replaced(self, old: list[Segment], ids: DataFrame) -> DataFrame:
        """The living documents with these ids, from the folders that the ids fall into."""
        folders = [r[0] for r in ids.select(_folder()).distinct().collect()]  # FOLDERS at most
        return self._living(old, "forward", folders).join(ids, "doc_id", "left_semi")

    def _partitions(self, words: int) -> int:
        return max(1, -(-words // self.partition_words))

    def _write_sorted(self, rows: DataFrame, part: str, words: int, *more: str) -> None:
        rows.repartitionByRange(self._partitions(words), "term").sortWithinPartitions("term", *more).write.parquet(f"{self.path}/segments/{part}")

    def _write_forward(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("folder", _folder()).repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/segments/{name}/forward")

    def _rows(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"))

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010}"

    def _version(self) -> int:
        return max((int(v) for v in self._list("manifests") if self._exists(f"{self.path}/manifests/{v}/_SUCCESS")), default=0)

    def _commit(self, own: list[Segment]) -> None:
        self.spark.createDataFrame([tuple(asdict(s).values()) for s in own], _MANIFEST).coalesce(1).write.parquet(self._manifest(self._version() + 1))

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _list(self, folder: str) -> list[str]:
        fs, path = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _exists(self, path: str) -> bool:
        fs, found = self._path(path)
        return fs.exists(found)

    def _delete(self, path: str) -> None:
        fs, found = self._path(path)
        fs.delete(found, True)


def _folder():
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FOLDERS)).cast("int").alias("folder")
