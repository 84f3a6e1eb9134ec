"""Files in the shared folder, opened by tasks: local, or any store Arrow can reach."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@contextmanager
def written(path: str, attempt: str):
    """A stream to ``path`` that becomes visible only when it is complete.

    Every task attempt writes a name of its own, and moves it into place at the end:
    a lost or repeated attempt leaves the same content or none.
    """
    store, at = located(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    draft = f"{at}.{attempt}.part"
    with store.open_output_stream(draft) as stream:
        yield stream
    store.move(draft, at)


def read_bytes(path: str) -> bytes:
    store, at = located(path)
    with store.open_input_file(at) as stream:
        return stream.read()
