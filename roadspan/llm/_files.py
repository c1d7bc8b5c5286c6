"""Binary files in the shared folder, written and read inside tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Output:
    """A file that appears under its name only when complete; a repeated task writes the same name again."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = at(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.position = 0

    def write(self, data) -> int:
        """Append and return where the data begins."""
        start = self.position
        self.stream.write(data)
        self.position += len(data)
        return start

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def open_input(uri: str):
    """Random access: ``read_at(size, offset)``, ``size()``; ``seek`` and ``read`` as well."""
    system, path = at(uri)
    return system.open_input_file(path)
