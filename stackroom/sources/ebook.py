"""EPUB and FB2 books."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from stackroom.sources.archive import SafeArchive, resolve
from stackroom.sources.html import html_sections
from stackroom.sources.office import _xml
from stackroom.sources.units import Refused, Unit, units


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(root, name: str):
    return next((x for x in root.iter() if _local(x.tag) == name), None)


def epub(content: bytes) -> Iterator[Unit]:
    """Chapters in reading order, each as sections under its headings; protected books are refused."""
    archive = SafeArchive(content)
    if "META-INF/rights.xml" in archive or "META-INF/encryption.xml" in archive and b"EncryptedKey" in archive.read("META-INF/encryption.xml"):
        raise Refused("the book is protected")
    rootfile = _first(_xml(archive.read("META-INF/container.xml")), "rootfile")
    if rootfile is None:
        raise Refused("no package")
    package = rootfile.get("full-path")
    root = _xml(archive.read(package))
    manifest = {x.get("id"): x for x in root.iter() if _local(x.tag) == "item"}
    titles = _titles(archive, package, manifest)
    n = 0
    for ref in (x for x in root.iter() if _local(x.tag) == "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None or ref.get("linear") == "no" or "html" not in (item.get("media-type") or ""):
            continue
        part = resolve(package, item.get("href"))
        n += 1
        for _, _, _, _, path, text in html_sections(archive.read(part)):
            names = path or ([titles[part]] if part in titles else [])
            yield "ebook_section", n, n, " › ".join(names) or None, names, text


def _titles(archive: SafeArchive, package: str, manifest: dict) -> dict[str, str]:
    """Chapter titles from the navigation document, else from the older table of contents."""
    navs = [x for x in manifest.values() if "nav" in (x.get("properties") or "").split()] + [x for x in manifest.values() if x.get("media-type") == "application/x-dtbncx+xml"]
    nav = navs[0] if navs else None
    if nav is None:
        return {}
    part = resolve(package, nav.get("href"))
    if part not in archive:
        return {}
    out: dict[str, str] = {}
    for x in _xml(archive.read(part)).iter():
        href = x.get("href") if _local(x.tag) == "a" else None
        title = " ".join("".join(x.itertext()).split()) if href else None
        if _local(x.tag) == "navPoint":
            src, label = _first(x, "content"), _first(x, "navLabel")
            href, title = (src.get("src"), " ".join("".join(label.itertext()).split())) if src is not None and label is not None else (None, None)
        if href and title:
            out.setdefault(resolve(part, href), title)
    return out


def fb2(content: bytes) -> Iterator[Unit]:
    """Sections under the titles above them; the .fbz form is a zip with one book."""
    raw = bytes(content)
    if raw[:2] == b"PK":
        archive = SafeArchive(raw)
        name = next((x for x in archive if x.lower().endswith(".fb2")), None)
        if name is None:
            raise Refused("no book in the archive")
        raw = archive.read(name)
    root = _xml(raw)

    def text_of(x) -> str:
        return " ".join("".join(x.itertext()).split())

    todo = [(b, []) for b in root if _local(b.tag) == "body"][::-1]
    n = 0
    while todo:
        section, path = todo.pop()
        title = next((text_of(x) for x in section if _local(x.tag) == "title"), "")
        own = [*path, title] if title else path
        lines = [t for x in section if _local(x.tag) not in ("section", "image") and (t := text_of(x))]
        if lines:
            n += 1
            yield "ebook_section", n, n, " › ".join(own) or None, own, "\n".join(lines)
        todo += [(x, own) for x in section if _local(x.tag) == "section"][::-1]


def ebook_units(rows: DataFrame, kind: str, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return units(rows, {"epub": epub, "fb2": fb2}[kind], content, list(keys))
