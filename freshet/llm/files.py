"""Files by URI, for writers and range readers that run in tasks.

``file:`` URIs and plain paths go to the local (or mounted) file system, all others to the
file system that pyarrow has for their scheme. Writers write under a name of their own and
move the result into place, so that a task that is run again, or twice at a time, leaves one
whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


@contextmanager
def written(uri: str) -> Iterator:
    """An output stream whose content appears at uri once the block has ended well."""
    fs, path = locate(uri)
    folder, _, name = path.rpartition("/")
    if folder:
        fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = fs.open_output_stream(own)
    try:
        yield out
        out.close()
        fs.move(own, path)
    except BaseException:
        if not out.closed:
            out.close()
        fs.delete_file(own)
        raise


class RangeReader:
    """Random access to files; keeps the last few open."""

    def __init__(self, keep: int = 8):
        self.keep = keep
        self.open: dict[str, object] = {}

    def _file(self, uri: str):
        if uri not in self.open:
            while len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            fs, path = locate(uri)
            self.open[uri] = fs.open_input_file(path)
        return self.open[uri]

    def size(self, uri: str) -> int:
        return self._file(uri).size()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        got = self._file(uri).read_at(length, offset)
        if len(got) != length:
            raise ValueError(f"{uri}: {length} bytes wanted at {offset}, {len(got)} there")
        return got

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()
