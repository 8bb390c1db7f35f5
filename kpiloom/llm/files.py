"""Binary files on the shared store, from executor tasks."""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file URI (a plain path is local)."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


class OnceFile:
    """A new file of this task attempt, made in ``folder`` when first written to.

    Names are unique per attempt: a retried or speculative task never touches
    another attempt's file, and only names that the winning attempt returns in its
    rows are ever read.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = store(folder)
        self.path = f"{base}/{name}"
        self.name = name
        self._out = None

    def open(self):
        if self._out is None:
            self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self._out = self.fs.open_output_stream(self.path, compression=None)
        return self._out

    def close(self):
        if self._out is not None:
            self._out.close()
