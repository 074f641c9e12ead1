"""Archives: an index of safe names, bounded reads, and references between entries."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote_to_bytes

# Limits of one entry, of one book, and of the ratio, which small entries need not keep.
ENTRY_LIMIT, BOOK_LIMIT, RATIO, SMALL = 256 << 20, 1 << 30, 200, 1 << 20


def clean_name(name: str) -> str:
    """The lexical path without one leading slash."""
    name = posixpath.normpath(name or ".")
    name = re.sub(r"\A/+", "/", name)
    return name[1:] if name.startswith("/") and len(name) > 1 else name


def size_text(n: int) -> str:
    return f"{n >> 30} GiB" if n >= 1 << 30 and n % (1 << 30) == 0 else f"{n >> 20} MiB"


class Archive:
    """Entries by cleaned name, the first of equal ones; names that leave the archive are dropped."""

    def __init__(self, data) -> None:
        """``data`` is the archive's bytes, or an open file of which only the directory and the entries asked for are read."""
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        except Exception as e:
            raise ValueError(f"damaged archive: {e}") from None
        self.entries: dict[str, zipfile.ZipInfo] = {}
        self.folded: dict[str, str] = {}
        self.total = 0
        for info in self.zip.infolist():
            name = info.filename.replace("\\", "/")
            if name.endswith("/") or name.startswith("/") or re.match(r"[A-Za-z]:", name):
                continue
            name = clean_name(name)
            if name == ".." or name.startswith("../") or name in self.entries:
                continue
            self.entries[name] = info
            self.folded.setdefault(name.lower(), name)

    def names(self) -> list[str]:
        return list(self.entries)

    def find(self, name: str) -> str | None:
        """The entry of a name, exactly or without regard to case."""
        name = clean_name(name)
        if name.startswith("../"):
            return None
        return name if name in self.entries else self.folded.get(name.lower())

    def read(self, name: str) -> bytes:
        """An entry's bytes, counted as they come; beyond a limit the book is refused."""
        found = self.find(name)
        if found is None:
            raise KeyError(f"{name} is not in the archive")
        info = self.entries[found]
        try:
            with self.zip.open(info) as f:
                data = f.read(ENTRY_LIMIT + 1)
        except Exception as e:
            raise ValueError(f"{found}: {e}") from None
        if len(data) > ENTRY_LIMIT:
            raise ValueError(f"{found} is larger than {size_text(ENTRY_LIMIT)}")
        if len(data) > SMALL and len(data) > RATIO * max(1, info.compress_size):
            raise ValueError(f"{found} expands more than {RATIO} times")
        self.total += len(data)
        if self.total > BOOK_LIMIT:
            raise ValueError(f"{found}: the book holds more than {size_text(BOOK_LIMIT)}")
        return data


def resolve(base: str, ref: str) -> str:
    """The entry that a reference inside ``base`` means."""
    ref = re.split("[#?]", ref, maxsplit=1)[0]
    if not re.search(r"%(?![0-9A-Fa-f]{2})", ref):
        ref = unquote_to_bytes(ref).decode("utf-8", "replace")
    return clean_name(ref) if ref.startswith("/") else clean_name(posixpath.join(posixpath.dirname(base), ref))
