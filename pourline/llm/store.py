"""Files of our own formats in the shared folder, whatever store that folder is in."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a path without a scheme is local."""
    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(folder: str, stem: str, suffix: str):
    """A new file for one task attempt; yields (stream, URI).

    Every attempt writes under a name of its own, and readers take names from the
    rows of the attempts that Spark accepted, so a lost or repeated attempt leaves
    at most a file that nobody reads.
    """
    uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None, buffer_size=1 << 20) as stream:
        yield stream, uri


def mapped(uri: str):
    """A file for random reading: memory-mapped where the store is a local or shared disk."""
    system, path = _place(uri)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path, "r")
    return system.open_input_file(path)
