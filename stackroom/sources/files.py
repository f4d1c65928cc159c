"""Folders as a scan, media types by content, and the choice of an extractor."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators.catalog import admitted, ignored
from stackroom.session import cut
from stackroom.sources.ebook import epub, fb2
from stackroom.sources.html import html_sections
from stackroom.sources.office import slides, spreadsheet, word
from stackroom.sources.text import csv_table, plain_text
from stackroom.sources.units import Extractor, units

#: Media types by file ending within the text family, and by an archive's content.
TEXT_ENDINGS = {"md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values", "html": "text/html", "htm": "text/html", "xhtml": "text/html"}
ZIP_PARTS = {"word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
EPUB, FB2 = "application/epub+zip", "application/x-fictionbook+xml"

EXTRACTORS: dict[str, Extractor] = {
    "text/plain": plain_text, "text/csv": csv_table, "text/tab-separated-values": lambda c: csv_table(c, "\t"), "text/html": html_sections, EPUB: epub, FB2: fb2,
    **dict(zip(ZIP_PARTS.values(), (word, spreadsheet, slides), strict=True)),
}


def walk(spark: SparkSession, root: str, recursive: bool = True, ignore: list[str] = (), include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path (below the root), content, length, modificationTime of a folder's regular files that no rule ignores.

    Rules are applied to paths before any content is read, as the content column is only read for rows that are kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    below = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://")[-1].replace(".", "\\.") + "/", "")
    name = F.element_at(F.split(below, "/"), -1)
    keep = ~ignored(below, F.lit(False), list(ignore)) & admitted(name, include, exclude)
    return files.filter(keep).withColumn("path", below)


_ENTRY = "path string, is_dir boolean, length long, modificationTime timestamp"


def _filesystem(root: str):
    """The file system of a root, and the root's path in it; for use within tasks."""
    import pyarrow.fs as pafs

    uri = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), root)


def listed(spark: SparkSession, root: str, recursive: bool = True, ignore: list[str] = (), entered=None) -> DataFrame:
    """path (below the root), is_dir, length, modificationTime of what no rule ignores, a level of folders at a time: an ignored folder is never entered.

    Each level's folders are listed in parallel. `entered`, an accumulator, counts the folders that are listed.
    """
    import pyarrow.fs as pafs

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)
        for pdf in batches:
            for folder in pdf["path"]:
                if entered is not None:
                    entered.add(1)
                own = fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/")))
                yield pd.DataFrame({"path": [f"{folder}/{x.base_name}".lstrip("/") for x in own], "is_dir": [x.type == pafs.FileType.Directory for x in own], "length": [x.size or 0 for x in own], "modificationTime": pd.to_datetime([x.mtime for x in own], utc=True)})

    level = spark.createDataFrame([("",)], "path string")
    found = []
    while True:
        below = level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(children, _ENTRY)
        found.append(cut(below.filter(~ignored(F.col("path"), F.col("is_dir"), list(ignore)))))
        level = found[-1].filter("is_dir").select("path")
        if not recursive or not level.take(1):
            return reduce(DataFrame.unionByName, found)


def walk_pruned(spark: SparkSession, root: str, recursive: bool = True, ignore: list[str] = (), include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """As walk(), by listed(): for folders of which much is ignored. A file's content is read in the task that its row is in."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with fs.open_input_stream(f"{base.rstrip('/')}/{row.path}") as f:
                    yield pd.DataFrame({"path": [row.path], "content": [f.read()], "length": [row.length], "modificationTime": [row.modificationTime]})

    found = listed(spark, root, recursive, ignore).filter(~F.col("is_dir") & admitted(F.element_at(F.split("path", "/"), -1), include, exclude))
    return found.mapInPandas(read, "path string, content binary, length long, modificationTime timestamp")


def _detect(head: bytes, name: str) -> str:
    ending = name.rpartition(".")[2].lower() if "." in name else ""
    if head[:4] == b"%PDF":
        return "application/pdf"
    if head[:2] == b"PK":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(head)).namelist())
        except zipfile.BadZipFile:
            return "application/zip"
        if "META-INF/container.xml" in names:
            return EPUB
        if any(n.lower().endswith(".fb2") for n in names):
            return FB2
        return next((t for p, t in ZIP_PARTS.items() if p in names), "application/zip")
    for magic, kind in ((b"\xd0\xcf\x11\xe0", "application/x-ole-storage"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")):
        if head.startswith(magic):
            return kind
    if b"\0" in head[:4096]:
        return "application/octet-stream"
    start = head[:2048].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if b"<fictionbook" in start:
        return FB2
    if start.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return TEXT_ENDINGS.get(ending, "text/plain")


def media_type(content: Column, name: Column) -> Column:
    """The media type by content, narrowed by name within the text family."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _detect(bytes(c), n or "") for c, n in zip(contents, names, strict=True)], dtype=object)

    return run(content, name)


def extract_all(files: DataFrame) -> DataFrame:
    """Units of all files (path, content, media_type): each type's own extractor, plain text for other texts, nothing for the rest."""
    parts = []
    for kind, extractor in EXTRACTORS.items():
        own = F.col("media_type") == kind
        if kind == "text/plain":
            own = F.col("media_type").startswith("text/") & ~F.col("media_type").isin(*[k for k in EXTRACTORS if k != kind])
        parts.append(units(files.filter(own), extractor, "content", ["path"]))
    return reduce(DataFrame.unionByName, parts)


def older_than(files: DataFrame, days: int, now: Column) -> DataFrame:
    """What a retention sweep removes."""
    return files.filter(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))
