"""Files that tasks write and read in the shared folder, by any scheme that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Committed:
    """A file that appears under its final name only when whole: written under a name of its own, then moved.

    A task that runs again, or twice at a time, writes the same bytes under another temporary name. Where the final name is taken by then
    (some stores refuse to move onto a file), the file there must have the same size, and the new copy goes.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = store(folder)
        self.fs.create_dir(f"{root}/_temporary")
        self.final = f"{root}/{name}"
        self.temporary = f"{root}/_temporary/{uuid.uuid4().hex}-{name}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temporary, self.final)
        except OSError:
            there = self.fs.get_file_info(self.final)
            if there.type != pafs.FileType.File or there.size != self.size:
                raise
            self.fs.delete_file(self.temporary)


def open_input(folder: str, name: str):
    fs, root = store(folder)
    return fs.open_input_stream(f"{root}/{name}", compression=None)


def read_bytes(folder: str, name: str) -> bytes:
    with open_input(folder, name) as f:
        return f.read()
