"""Column helpers for edge-list text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The header line format and its keys.
HEADER_MARK = "#"
HEADER_PATTERN = r"^[#\s]*([^:#]+?)\s*:\s*([^:]*?)[#\s]*$"
HEADER_KEYS = ["graph_type", "n_nodes", "n_edges", "n_components", "diameter"]
BLANKS = " \t\r\n"


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def tokens(line: Column) -> Column:
    return F.split(stripped(line), r"\s+")


def id_token(parts: Column, position: int) -> Column:
    """Token as a 64-bit id, null if it is missing or not a number."""
    return F.try_element_at(parts, F.lit(position)).try_cast("bigint")


def is_header(line: Column) -> Column:
    return stripped(line).startswith(HEADER_MARK)


def header_key(line: Column) -> Column:
    return F.regexp_extract(line, HEADER_PATTERN, 1)


def header_value(line: Column) -> Column:
    return F.regexp_extract(line, HEADER_PATTERN, 2)


def display_name(identifier: Column) -> Column:
    """``web_google`` as ``Web Google``."""
    return F.initcap(F.regexp_replace(identifier, "_", " "))
