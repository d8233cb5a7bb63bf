"""Files of a source, on whatever file system their path names."""

from __future__ import annotations

import pyarrow.fs as pafs

HIDDEN = ("_", ".")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def is_dir(path: str) -> bool:
    fs, p = file_system(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def exists(path: str) -> bool:
    fs, p = file_system(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def files(path: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of all files under a folder at any depth; hidden ones are left out."""
    fs, p = file_system(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    scheme = path[: len(path) - len(p)] if path.endswith(p) else path.partition("://")[0] + "://"
    inside = fs.get_file_info(pafs.FileSelector(p, recursive=True))
    good = [i for i in inside if i.type == pafs.FileType.File and not any(x.startswith(HIDDEN) for x in i.path[len(p) :].strip("/").split("/"))]
    return sorted((scheme + i.path, i.size) for i in good)


def read_bytes(path: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, p = file_system(path)
    with fs.open_input_file(p) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def write_bytes(path: str, data: bytes) -> None:
    """A whole file; its folder is made."""
    fs, p = file_system(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)
