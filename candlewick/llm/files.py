"""Files of a shared folder, opened on executors: local ones directly, others by pyarrow."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow.fs as pafs


def _fs(uri: str):
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def open_write(uri: str):
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_read(uri: str):
    fs, path = _fs(uri)
    return fs.open_input_file(path)
