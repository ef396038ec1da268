"""Binary files in the shared folder, written once and read by ranges from any executor."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """A new file under ``folder``; every attempt of a task writes to a name of its own."""

    def __init__(self, folder: str, suffix: str):
        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = _resolve(self.path)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)
        self.size = 0

    def append(self, data: bytes) -> tuple[int, int]:
        """(offset, length) of the data in the file."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self._out.close()


class Reader:
    """Range reads, with the last few files kept open."""

    def __init__(self, keep: int = 8):
        self._open: dict[str, object] = {}
        self._keep = keep

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self._open:
            while len(self._open) >= self._keep:
                self._open.pop(next(iter(self._open))).close()
            system, name = _resolve(path)
            self._open[path] = system.open_input_file(name)
        return self._open[path].read_at(length, offset)

    def read_all(self, path: str) -> bytes:
        system, name = _resolve(path)
        with system.open_input_stream(name, compression=None) as f:
            return f.read()
