"""Files that tasks write into, and read from, the folder that all executors share."""

from __future__ import annotations

import io
import os
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np


def _place(path: str):
    """(file system or None for mounted folders, path)."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return None, u.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, parts) -> None:
    """Write the parts under a name of its own, then give the file its name: a reader never sees half a file."""
    system, p = _place(path)
    if system is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p + ".part", "wb") as f:
            f.writelines(parts)
        os.replace(p + ".part", p)
        return
    system.create_dir(os.path.dirname(p), recursive=True)
    with system.open_output_stream(p + ".part") as f:
        for x in parts:
            f.write(x)
    system.move(p + ".part", p)


@contextmanager
def opened(path: str):
    system, p = _place(path)
    if system is None:
        with open(p, "rb") as f:
            yield f
    else:
        with system.open_input_stream(p) as f:
            yield f


def save(path: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    write_bytes(path, [out.getbuffer()])


def load(path: str) -> np.ndarray:
    with opened(path) as f:
        return np.load(io.BytesIO(f.read()))
