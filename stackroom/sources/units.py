"""Turning files' contents into citable units, row by row and in bounded memory.

An extractor is a generator over one content that yields (kind, first, last, name, heading_path,
extracted). units() runs it over a DataFrame and adds ordinals and the search form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATOR = T.StructType([T.StructField("type", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType()))])
UNIT_FIELDS = [T.StructField("ordinal", T.IntegerType()), T.StructField("locator", LOCATOR), T.StructField("extracted_text", T.StringType()), T.StructField("search_text", T.StringType())]

Unit = tuple[str, int | None, int | None, str | None, list[str], str]
Extractor = Callable[..., Iterator[Unit]]


def search_form(text: str) -> str:
    """The same as functions.text.normalize, for extractors that run in Python."""
    if text.isascii() and text.isprintable():
        return text
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return "".join(c for c in unicodedata.normalize("NFC", text) if c in "\n\t" or unicodedata.category(c) != "Cc")


def units(rows: DataFrame, extractor: Extractor, content: str, keys: list[str], *more: str, batch: int = 256) -> DataFrame:
    """keys, ordinal, locator, extracted_text, search_text for each unit of each row; `more` columns go to the extractor as well.

    A content that is null or can't be read has no units; unreadable ones are found by refused().
    """
    schema = T.StructType([*(rows.schema[k] for k in keys), *UNIT_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                value = getattr(row, content)
                if value is None:
                    continue
                own = [getattr(row, k) for k in keys]
                try:
                    for n, (kind, first, last, name, path, text) in enumerate(extractor(value, *(getattr(row, m) for m in more))):
                        out.append((*own, n, (kind, first, last, name, path), text.removeprefix("﻿"), search_form(text)))
                        if len(out) >= batch:
                            yield pd.DataFrame(out, columns=schema.names)
                            out = []
                except Refused:
                    continue
            yield pd.DataFrame(out, columns=schema.names)

    return rows.select(*dict.fromkeys([*keys, content, *more])).mapInPandas(run, schema)


class Refused(ValueError):
    """A content that an extractor won't read, with a reason."""


def refused(rows: DataFrame, extractor: Extractor, content: str, keys: list[str], *more: str) -> DataFrame:
    """keys and reason of the contents that an extractor refuses."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    for _ in extractor(getattr(row, content), *(getattr(row, m) for m in more)) if getattr(row, content) is not None else ():
                        pass
                except Refused as e:
                    out.append((*(getattr(row, k) for k in keys), str(e)))
            yield pd.DataFrame(out, columns=schema.names)

    return rows.select(*dict.fromkeys([*keys, content, *more])).mapInPandas(run, schema)


def decoded(content: str | bytes) -> str:
    return content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")


def whole_text(rows: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """The fallback: a document as one unit with its number of lines; stays in the JVM."""
    lines = F.regexp_count(content, F.lit("\r\n|\r|\n")) + F.when(F.col(content).rlike("[\r\n]$") | (F.col(content) == ""), 0).otherwise(1)
    return rows.select(*keys, F.lit(0).alias("ordinal"), F.greatest(lines, F.lit(1)).alias("n_lines"), F.col(content).alias("extracted_text"))
