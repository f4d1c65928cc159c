"""Archives read under limits."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

from stackroom.sources.units import Refused

MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL, MOST_RATIO = 20_000, 64 << 20, 512 << 20, 200


class SafeArchive:
    """A zip whose entries are few, small, not absurdly compressed and inside it."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(bytes(content)))
        except zipfile.BadZipFile as e:
            raise Refused("not an archive") from e
        entries = self.zip.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_TOTAL:
            raise Refused("archive too large")
        self.names: dict[str, zipfile.ZipInfo] = {}
        for e in entries:
            name = canonical(e.filename)
            if e.file_size > MOST_ENTRY or e.file_size > MOST_RATIO * max(e.compress_size, 1) + 4096:
                raise Refused("archive entry too large")
            self.names[name] = e

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise Refused(f"{name} is missing")
        with self.zip.open(self.names[name]) as f:
            raw = f.read(MOST_ENTRY + 1)
        if len(raw) > MOST_ENTRY:
            raise Refused("archive entry too large")
        return raw


def canonical(name: str) -> str:
    """A path inside the archive; absolute ones and ones that leave it are refused."""
    clean = name.replace("\\", "/")
    out = posixpath.normpath(clean)
    if clean.startswith("/") or out.startswith("..") or ":" in clean.split("/")[0]:
        raise Refused("a path leaves the archive")
    return out


def resolve(base: str, href: str) -> str:
    """What a link in an entry points to, without its fragment."""
    return canonical(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0])))
