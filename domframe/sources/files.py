"""Small files by path or URI, local or not, for drivers and tasks alike."""
from __future__ import annotations

import json

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read(path: str) -> bytes | None:
    """Content of a file; None if there is none."""
    system, p = at(path)
    if system.get_file_info(p).type != fs.FileType.File:
        return None
    with system.open_input_stream(p) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """Writes a file whole: it shows under its name when it is complete."""
    system, p = at(path)
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{p}.new") as f:
        f.write(data)
    system.move(f"{p}.new", p)


def read_json(path: str):
    data = read(path)
    return None if data is None else json.loads(data)


def write_json(path: str, value) -> None:
    write(path, json.dumps(value, indent=2, sort_keys=True).encode())


def listed(path: str, folders: bool) -> list[str]:
    """Names of the folders, or of the files, right in a folder; none if it does not exist."""
    system, p = at(path)
    if system.get_file_info(p).type != fs.FileType.Directory:
        return []
    kind = fs.FileType.Directory if folders else fs.FileType.File
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(p)) if x.type == kind)


def delete(path: str) -> None:
    system, p = at(path)
    kind = system.get_file_info(p).type
    if kind == fs.FileType.Directory:
        system.delete_dir(p)
    elif kind == fs.FileType.File:
        system.delete_file(p)


def make_dir(path: str) -> None:
    system, p = at(path)
    system.create_dir(p, recursive=True)


def move(source: str, target: str) -> None:
    system, p = at(source)
    q = at(target)[1]
    system.create_dir(q.rsplit("/", 1)[0], recursive=True)
    system.move(p, q)


def copy_dir(source: str, target: str) -> None:
    (a, p), (b, q) = at(source), at(target)
    fs.copy_files(p, q, source_filesystem=a, destination_filesystem=b)
