"""Files below the shared folder, opened by executors and driver alike through Arrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the path in it; the folder is made if it isn't there."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


@contextmanager
def replaced(system: fs.FileSystem, path: str):
    """A stream whose bytes appear at path when all are written; a task that runs again, or twice at once, leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    stream = system.open_output_stream(own)
    try:
        yield stream
        stream.close()
        system.move(own, path)
    except BaseException:
        stream.close()
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_file(own)
        raise
