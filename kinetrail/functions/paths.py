"""Canonical names of files, as Spark expressions.

A path names the same file whatever its mount root or scheme, separators,
letter case and padding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that pads names, Unicode spaces included.
PADDING = " \t\n\r\x0b\x0c\x85  " + "".join(map(chr, range(0x2000, 0x200C))) + "    　﻿"


def trimmed(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.btrim(c, F.lit(PADDING))


def flat_path(c: Column) -> Column:
    """Lower case, forward slashes, no doubled, dotted or padded parts; NULL for empty names."""
    x = F.translate(F.lower(trimmed(c)), "\\", "/")
    x = F.regexp_replace(x, r"/(?:\./|/)+", "/")
    # each expression stands once, as patterns are the cost here
    return F.nullif(F.regexp_replace(x, r"^\./", ""), F.lit(""))


def project_path(c: Column) -> Column:
    """The part of a trajectory or chunk path from its project directory on; other paths in full."""
    return F.regexp_replace(flat_path(c), r"^(?!proj\d+/).*?/(?=proj\d+/)", "")


def topology_path(c: Column) -> Column:
    """The last directory and the file name of a topology path; a bare file name stays as it is."""
    return F.regexp_extract(flat_path(c), r"([^/]+/)?[^/]+$", 0)


def base_name(c: Column) -> Column:
    """The file name without directory, case and padding; NULL for empty names."""
    return F.nullif(F.regexp_extract(flat_path(c), r"[^/]+$", 0), F.lit(""))
