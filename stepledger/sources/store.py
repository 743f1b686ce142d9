"""Files of any store by name, for the tasks that open or list them themselves."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs


def opened(file: str) -> tuple[fs.FileSystem, str]:
    """The store of a full name such as ``s3://…`` or ``file:/…``, and the path in it."""
    scheme, colon, path = file.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (path if colon else file).lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(path)}")


def is_hidden(name: str) -> bool:
    """Work files of writers, which no reader shows."""
    return name.startswith(("_", "."))


def content(file: str) -> bytes | None:
    """The bytes of a file; none where there is no such file."""
    store, path = opened(file)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as stream:
        return stream.read()
