"""Files of any store that executors share, for data sources that run in Python."""

from __future__ import annotations

import urllib.request


def remote(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def store(url: str):
    """(file system, path) of a place such as file:///a, hdfs://host/a, s3://bucket/a or /a."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else fs.FileSystem.from_uri("file://" + url if not url.startswith("file:") else url.replace("file:", "file://", 1))


def read_text(url: str, timeout: float = 60.0) -> str:
    """A web address's or a file's text."""
    if remote(url):
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.read().decode()
    files, path = store(url)
    with files.open_input_stream(path) as f:
        return f.read().decode()


def listed(url: str, prefix: str) -> list[tuple[int, list[str]]]:
    """(number, files) of the folders ``prefix=number`` below a folder, by number, as a partitioned write leaves them."""
    from pyarrow import fs

    files, path = store(url)
    found = []
    for x in files.get_file_info(fs.FileSelector(path)):
        name = x.path.rsplit("/", 1)[-1]
        if name.startswith(f"{prefix}="):
            own = files.get_file_info(fs.FileSelector(x.path))
            scheme = url.split("://")[0] + "://" if "://" in url else ""
            found.append((int(name.split("=")[1]), sorted(scheme + y.path for y in own if not y.path.rsplit("/", 1)[-1].startswith(("_", ".")))))
    return sorted(found)
