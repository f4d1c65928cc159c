"""Approximate nearest vectors: a coarse quantiser with inverted lists.

Centroids come from k-means over a bounded sample; every vector goes to the list of the centroid
with the largest dot product with it, and lists are written as folders, so that a query reads
those it probes and no others. Vectors are compared by dot product, as in `nearest`; the
quantiser looks at directions only.

A search stays exact where that costs no more: in a scope of max(EXACT, 4 x k) vectors at most, or of any size where
the caller wants that (one scan, k rows a task). Else the lists
nearest to the query are probed, and more of them, twice as many each time, until k vectors of the scope are found or
no list is left. How many lists are probed at first is measured when they are written: for a
bounded sample of vectors, in how many lists, the nearest first, TARGET of their exact neighbours are. Vectors
without clusters need many. `recall()` measures an index on other queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.operators.search import PER_BRANCH, best_many, dot, nearest, nearest_many
from stackroom.session import cut

#: Scopes up to this many vectors (or four times the limit) are searched exactly.
EXACT = 1000
#: Sampled vectors for each list that the quantiser is fitted on, and lists at most.
SAMPLED, MOST_LISTS = 64, 4096
#: Sampled vectors whose neighbours say how many lists to probe, neighbours of each, and how many of them are to be found.
ASKED, NEIGHBOURS, TARGET = 256, 30, 0.95


@dataclass
class Lists:
    """Inverted lists: `vectors` (key, column, list) in folders by list, the centroids, MOST_LISTS at most, and how many lists a query probes at first."""

    vectors: DataFrame
    centroids: np.ndarray
    key: str
    column: str
    probes: int

    @property
    def listed(self) -> DataFrame:
        """The vectors of the quantiser's size."""
        return self.vectors.filter(F.size(self.column) == self.centroids.shape[1])

    def order(self, query) -> list[int]:
        """All lists, the nearest first."""
        return np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable").tolist()


def write_lists(vectors: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", lists: int | None = None, seed: int = 1) -> None:
    """Fit the quantiser (about the square root of the number of vectors lists), and write every vector into its list and the centroids beside them.

    Vectors of another size than most have are in a list of their own, -1, that only exact searches read; null ones are left out.
    """
    vectors = vectors.filter(F.size(column) > 0)
    sizes = vectors.groupBy(F.size(column).alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    dimension, n = tuple(sizes) if sizes else (1, 0)
    lists = max(1, min(MOST_LISTS, lists or round(math.sqrt(n))))
    size = F.sqrt(dot(F.col(column), F.col(column)))
    unit = F.when(size > 0, F.transform(column, lambda x: x.cast("double") / size)).otherwise(F.transform(column, lambda x: F.lit(0.0)))
    own = vectors.filter(F.size(column) == dimension).withColumn("_unit", array_to_vector(unit))
    rest = vectors.filter(F.size(column) != dimension).withColumn("list", F.lit(-1))
    share = min(1.0, SAMPLED * lists / max(n, 1))
    sample = cut(own.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("_unit"))  # SAMPLED * lists rows, about
    spark = vectors.sparkSession
    if not sample.take(1):
        centroids, placed = np.zeros((1, dimension)), own.drop("_unit").withColumn("list", F.lit(0))
    else:
        model = KMeans(featuresCol="_unit", predictionCol="list", k=lists, seed=seed, maxIter=10).fit(sample)
        centroids = np.array(model.clusterCenters())
        placed = model.transform(own).drop("_unit")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    placed.unionByName(rest).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    probes = _measured(Lists(spark.read.parquet(f"{path}/vectors"), centroids, key, column, len(centroids)), n, seed)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def _measured(lists: Lists, n: int, seed: int) -> int:
    """In how many lists, in the order that a query probes them, TARGET of the neighbours of some stored vectors are."""
    own = F.pmod(F.xxhash64(F.lit(seed + 1), lists.key), F.lit(1 << 20)) < int(min(1.0, ASKED / max(n, 1)) * (1 << 20)) + 1
    asked = cut(lists.listed.filter(own).select(F.col(lists.key).alias("query_id"), F.col(lists.column).alias("vector")))
    found = nearest_many(lists.listed, asked, NEIGHBOURS, lists.key, lists.column).join(lists.vectors.select(lists.key, "list"), lists.key).select("query_id", "list")
    places = _probed(lists, asked, len(lists.centroids)).select("query_id", "list", "place").join(found, ["query_id", "list"])
    return places.agg(F.percentile("place", F.lit(TARGET))).first()[0].__ceil__() if places.take(1) else 1


def read_lists(spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding") -> Lists:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return Lists(spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows]), key, column, spark.read.parquet(f"{path}/probes").first()[0])


def approximate(lists: Lists, query: list[float], k: int = PER_BRANCH, probes: int | None = None, scope: DataFrame | None = None, exact: int | None = EXACT) -> DataFrame:
    """About the top k by (1 + dot) / 2, as `nearest` gives them; exactly those in a scope of max(exact, 4 x k) vectors at most, or in any scope if exact is None."""
    rows = lists.vectors.filter(F.size(lists.column) == len(query))
    if scope is not None and exact is None:
        return nearest(rows, query, k, lists.key, lists.column, scope)
    if scope is not None:
        scope = cut(scope.select(lists.key).distinct())
        rows = rows.join(scope, lists.key, "left_semi")
    limit = max(EXACT if exact is None else exact, 4 * k)
    n = (scope if scope is not None else rows.select(lists.key)).limit(limit + 1).count()
    if n <= limit:
        return nearest(rows, query, k, lists.key, lists.column)
    order = lists.order(query)
    probed = probes or lists.probes
    while probed < len(order) and rows.filter(F.col("list").isin(order[:probed])).limit(k).count() < k:
        probed *= 2
    return nearest(rows.filter(F.col("list").isin(order[:probed])), query, k, lists.key, lists.column)


def _nearest_lists(vectors: pd.Series, centroids: np.ndarray) -> np.ndarray:
    """All lists of each vector, the nearest first."""
    return np.argsort(-(np.stack(vectors).astype(float) @ centroids.T), axis=1, kind="stable")


def _probed(lists: Lists, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, vector, list, place: each query with its nearest lists, counted from 1."""
    sent = queries.sparkSession.sparkContext.broadcast(lists.centroids)  # MOST_LISTS at most

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["lists"] = list(_nearest_lists(pdf["vector"], sent.value)[:, :probes].astype(np.int32))
                yield pdf

    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("lists", T.ArrayType(T.IntegerType()))])
    near = queries.select("query_id", "vector").filter(F.size("vector") == lists.centroids.shape[1]).mapInPandas(probe, schema)
    return near.select("query_id", "vector", F.posexplode("lists").alias("place", "list")).withColumn("place", F.col("place") + 1)


def approximate_many(lists: Lists, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, key, score, rank: about the top k of each of many queries (query_id, vector).

    Ranks are by the dot product and then by key, as in nearest_many(). Queries go to the lists, as there, with
    a bit for each list that they probe: a list's vectors are multiplied with its queries, and no pair becomes a row.
    """
    n, first = len(lists.centroids), probes or lists.probes
    sent = queries.sparkSession.sparkContext.broadcast(lists.centroids)  # MOST_LISTS at most

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                own = pdf.iloc[at : at + 256]
                probed = np.zeros((len(own), n), bool)
                np.put_along_axis(probed, _nearest_lists(own["vector"], sent.value)[:, :first], True, 1)
                yield own.assign(lists=[x.tobytes() for x in np.packbits(probed, axis=1)])

    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("lists", T.BinaryType())])
    asked = queries.select("query_id", "vector").filter(F.size("vector") == lists.centroids.shape[1]).mapInPandas(probe, schema)
    found = best_many(lists.listed, asked, k, lists.key, lists.column)
    return found.select("query_id", lists.key, F.round((1 + F.col("score")) / 2, 6).alias("score"), "rank")


def recall(lists: Lists, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id and found: how many of the exact top k the approximate search gives."""
    queries = queries.filter(F.size("vector") == lists.centroids.shape[1])
    exact = nearest_many(lists.listed, queries, k, lists.key, lists.column).select("query_id", lists.key)
    both = exact.join(approximate_many(lists, queries, k, probes).select("query_id", lists.key, F.lit(1).alias("hit")), ["query_id", lists.key], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
