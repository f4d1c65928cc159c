"""Streams: ingest that survives restarts, index upkeep, deduplication, sliding limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_folder(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Files that come into a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def replace_into(table_path: str, transform: Callable[[DataFrame], DataFrame], key: str = "bucket") -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that overwrites the partitions a batch touches: a batch that comes again changes nothing."""

    def write(batch: DataFrame, _number: int) -> None:
        transform(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table_path)

    return write


def keep_index(segments) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that takes changes of documents into an index of segments, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        segments.apply(batch, number)

    return write


def resume(units: DataFrame, checkpoints: DataFrame, fingerprint: str, retry_failed: bool = False) -> DataFrame:
    """Units (doc_id, ordinal) not yet done under this fingerprint; or only those that failed."""
    own = checkpoints.filter(F.col("fingerprint") == fingerprint)
    if retry_failed:
        return units.join(own.filter("state = 'FAILED'").select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi")
    return units.join(own.filter("state = 'DONE'").select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")


def first_copies(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One row for each (collection, sha256) within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["collection", "sha256"])


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and time window, late ones within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def limited(attempts: DataFrame, minutes: int = 15, most: int = 10) -> DataFrame:
    """Attempts (who, ts, ok) with refused: `most` failures of the same key in the last minutes; a success clears the key.

    State is the times of a key's recent failures, `most` at the most.
    """
    span = minutes * 60_000_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            now = int(ts.value // 1000)
            times = [t for t in times if now - t < span]
            refused = len(times) >= most
            out.append((key[0], ts, bool(ok), refused))
            if not refused:
                times = [] if ok else [*times, now]
        state.update((times,))
        yield pd.DataFrame(out, columns=["who", "ts", "ok", "refused"])

    return attempts.groupBy("who").applyInPandasWithState(judge, "who string, ts timestamp, ok boolean, refused boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def sign_in_waits(events: DataFrame, minutes: int = 15, per_user: int = 10, per_address: int = 50, late: str = "1 hour") -> DataFrame:
    """For each check a row (id, wait) for its user and one for its address: the seconds to wait, null where it is admitted.

    events: id, ts, kind (check, failure or success), username, address. A failure counts for the user, whatever the case,
    and for the address, as long as it is in the window; a success clears the user's failures and leaves the address's. A key at its
    limit waits until its oldest failure leaves the window. State is a key's failures in the window, and goes once they have left it;
    events may come so much later than others.
    """
    span, limits = minutes * 60_000_000, {"user": per_user, "address": per_address}
    keys = F.explode(F.array(F.struct(F.lit("user").alias("of"), F.lower("username").alias("key")), F.struct(F.lit("address").alias("of"), F.col("address").alias("key")))).alias("k")
    each = events.withWatermark("ts", late).select("id", "ts", "kind", keys).select("id", "ts", "kind", "k.of", "k.key")

    def singly(key: tuple, times: list[int], ids, at, kinds, state: GroupState) -> pd.DataFrame:
        out = []
        for id_, now, kind in zip(ids, at.tolist(), kinds, strict=True):
            times = [t for t in times if t > now - span]
            if kind == "failure":
                times.append(now)
            elif kind == "success":
                times = [] if key[0] == "user" else times
            else:
                full = len(times) >= limits[key[0]]
                out.append((id_, max(1, -(-((times[0] + span - now) // 1000) // 1000)) if full else None))
        state.update((times,))
        state.setTimeoutTimestamp(max(now // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        return pd.DataFrame(out, columns=["id", "wait"]).astype({"id": "int64", "wait": "Int64"})

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        now, kind = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64"), rows["kind"].to_numpy()
        held, failed, check = list(state.get[0]) if state.exists else [], kind == "failure", kind == "check"
        times = np.concatenate([np.array(held, np.int64), now[failed]])
        if (np.diff(times) < 0).any():  # failures that came late stand behind later ones: one at a time
            yield singly(key, held, rows["id"], now, kind, state)
            return
        # of the failures so far, those from `first` on count: in the window, and after the user's last success
        so_far = len(held) + np.cumsum(failed)
        cleared = np.maximum.accumulate(np.where((kind == "success") & (key[0] == "user"), so_far, 0))
        first = np.maximum(np.searchsorted(times, now - span, side="right"), cleared)
        full = check & (so_far - first >= limits[key[0]])
        wait = np.zeros(len(rows), np.int64)
        wait[full] = np.maximum(1, -(-((times[first[full]] + span - now[full]) // 1000) // 1000))
        state.update((times[first[-1] :].tolist(),))
        state.setTimeoutTimestamp(max(int(now[-1] // 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"].to_numpy()[check], "wait": pd.array(wait[check], "Int64")}).astype({"id": "int64"}).assign(wait=lambda x: x["wait"].mask(~full[check]))

    return each.groupBy("of", "key").applyInPandasWithState(judge, "id long, wait long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def longest_waits(waits: DataFrame) -> DataFrame:
    """id, wait and whether it is refused, of the two rows of each check, which come in one batch."""
    return waits.groupBy("id").agg(F.max("wait").alias("wait")).withColumn("refused", F.col("wait").isNotNull())
