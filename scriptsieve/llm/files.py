"""Files in the folder that driver and executors share, on any file system that pyarrow knows by its URI."""

from __future__ import annotations

import contextlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Draft:
    """A file written under a temporary name that only this attempt has, and moved to its own when it is complete. An attempt that dies leaves no file by that name; one that repeats another writes the same bytes."""

    def __init__(self, folder: str, name: str):
        self.system, self.folder = opened(folder)
        self.name, self.hidden = f"{self.folder}/{name}", f"{self.folder}/_temporary-{name}-{uuid.uuid4().hex}"
        self.system.create_dir(self.folder, recursive=True)
        self.stream = self.system.open_output_stream(self.hidden, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.hidden, self.name)

    def drop(self) -> None:
        with contextlib.suppress(OSError):
            self.stream.close()
            self.system.delete_file(self.hidden)


def read(uri: str) -> fs.FileSystem:
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)


def seekable(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    """Removes a folder with what is in it."""
    system, path = opened(uri)
    system.delete_dir(path)


def there(uri: str) -> bool:
    system, path = opened(uri)
    return system.get_file_info(path).type == fs.FileType.File


def mapped(uri: str) -> pa.Buffer:
    """The contents of a file, mapped into memory on a local file system."""
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with system.open_input_file(path) as stream:
        return stream.read_buffer()
