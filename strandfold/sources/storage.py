"""Files on any file system that Arrow knows, by local path or URI (file://, hdfs://, s3://, gs://)."""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Callable

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in path)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    fs, inner = pafs.FileSystem.from_uri(path)
    path = path.rstrip("/") if len(inner) > 1 else path
    return fs, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def is_dir(path: str) -> bool:
    fs, p, _ = place(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def is_file(path: str) -> bool:
    fs, p, _ = place(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def size(path: str) -> int:
    fs, p, _ = place(path)
    return fs.get_file_info(p).size


def files(folder: str) -> list[str]:
    """The files right in a folder, by name, written like the folder; hidden ones are left out."""
    fs, p, before = place(folder)
    found = fs.get_file_info(pafs.FileSelector(p))
    return sorted(before + f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def find(path: str, good: Callable[[str], bool]) -> list[str]:
    """One file, the good files of a folder, or those whose names fit a pattern (* ? [) in the last part of path."""
    if is_dir(path):
        return [f for f in files(path) if good(f)]
    if is_file(path):
        return [path]
    folder, _, pattern = path.rpartition("/")
    found = [f for f in files(folder or ".") if fnmatch.fnmatch(f.rpartition("/")[2], pattern)] if any(c in pattern for c in "*?[") and is_dir(folder or ".") else []
    if not found:
        raise FileNotFoundError(path)
    return found


def reader(path: str) -> io.BufferedReader:
    """A file to read and seek in."""
    fs, p, _ = place(path)
    return io.BufferedReader(fs.open_input_file(p), 1 << 20)


def text_reader(path: str) -> io.BufferedIOBase:
    """The bytes of a file, unpacked if its name ends in .gz."""
    f = reader(path)
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f


def writer(path: str):
    """A new file; its folder is made where the file system has folders."""
    fs, p, _ = place(path)
    folder = p.rpartition("/")[0]
    if folder:
        fs.create_dir(folder, recursive=True)
    return fs.open_output_stream(p, compression=None)


def move(path: str, to: str) -> None:
    fs, p, _ = place(path)
    fs.move(p, place(to)[1])


def remove(path: str) -> None:
    fs, p, _ = place(path)
    fs.delete_dir(p) if fs.get_file_info(p).type == pafs.FileType.Directory else fs.delete_file(p)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if folder else name
