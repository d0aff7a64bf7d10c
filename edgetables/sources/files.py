"""Files in a cluster's shared folders, opened from tasks by the paths that Spark gives them."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from edgetables.functions.text import BLANKS, HEADER_KEYS, HEADER_MARK, HEADER_PATTERN

#: Hadoop's names of schemes that Arrow knows by another one.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
LOCATION = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*|)", re.S)
LONGEST_LINE = 1_000_000  # characters of a line looked at; no header entry is that long
READ_BYTES = 65_536


def arrow_location(path: str) -> tuple[str, str, str]:
    """``(scheme, host or bucket, path)`` as Arrow's file systems want them."""
    scheme, host, rest = LOCATION.fullmatch(path).groups()
    scheme = (scheme or "file").lower()
    return ARROW_SCHEMES.get(scheme, scheme), host or "", rest


def open_filesystem(path: str):
    """Arrow's file system for a path as Spark writes it, and the path in it."""
    from pyarrow import fs

    scheme, host, rest = arrow_location(path)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    files, root = fs.FileSystem.from_uri(f"{scheme}://{host}")
    return files, root.rstrip("/") + rest


def lines_of(stream: io.TextIOBase) -> Iterator[str]:
    """Lines without their ends, the rest of very long ones left out."""
    while line := stream.readline(LONGEST_LINE):
        yield line.rstrip("\n")
        while line and not line.endswith("\n") and len(line) == LONGEST_LINE:
            line = stream.readline(LONGEST_LINE)


def header_entries(stream: io.TextIOBase) -> dict[str, str]:
    """Known ``# key: value`` entries above the first line that is neither comment nor blank; the largest of several."""
    entry = re.compile(HEADER_PATTERN, re.ASCII).match
    found: dict[str, str] = {}
    for line in lines_of(stream):
        bare = line.strip(BLANKS)
        if bare and not bare.startswith(HEADER_MARK):
            break
        if bare and (match := entry(line)) and match[1] in HEADER_KEYS:
            found[match[1]] = max(found.get(match[1], ""), match[2])
    return found


def read_header(path: str) -> dict[str, str]:
    """The header of one file, plain or compressed; nothing behind it is read but the rest of a buffer."""
    files, place = open_filesystem(path)
    with files.open_input_stream(place, compression="detect", buffer_size=READ_BYTES) as raw:
        return header_entries(io.TextIOWrapper(raw, "utf-8", errors="replace"))
