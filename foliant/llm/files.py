"""Binary files in the folder that executors share."""

from __future__ import annotations

import io

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a uri: a local path, file:, hdfs:, s3:, gs: and what else pyarrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Ranged(io.RawIOBase):
    """A file read by ranges, with a buffer of one block: seekable, and never held whole."""

    def __init__(self, uri: str, block: int = 1 << 20):
        fs, path = opened(uri)
        self.file, self.block, self.at, self.first, self.buffer = fs.open_input_file(path), block, 0, 0, b""
        self.size = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (self.at if whence == 1 else self.size if whence == 2 else 0)
        return self.at

    def bytes_at(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.first <= at and at + n <= self.first + len(self.buffer)):
            self.first, self.buffer = at, self.file.read_at(max(n, min(self.block, self.size - at)), at) if n else b""
        return self.buffer[at - self.first : at - self.first + n]

    def read(self, n: int = -1) -> bytes:
        found = self.bytes_at(self.at, self.size - self.at if n is None or n < 0 else n)
        self.at += len(found)
        return found

    def readinto(self, into) -> int:
        found = self.read(len(into))
        into[: len(found)] = found
        return len(found)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()
