"""Logs of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "timestamp string, level string, logger string, message string, component string, job string, document string, fields map<string,string>, exception string"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files; malformed lines go."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("timestamp IS NOT NULL AND level IS NOT NULL")


def follow_logs(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files that come."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("timestamp IS NOT NULL AND level IS NOT NULL")
