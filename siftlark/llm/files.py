"""Files in the shared folder, written and read inside tasks through Arrow file systems."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str) -> Iterator[fs.FileSystem]:
    """A stream whose file appears under ``uri`` only when complete.

    A retried or speculative attempt writes its own hidden file and then replaces the same final
    name with the same bytes, so a lost executor leaves no half-written file behind.
    """
    store, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(hidden) as out:
            yield out
        store.move(hidden, path)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(hidden)
        raise
