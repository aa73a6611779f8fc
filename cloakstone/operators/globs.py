"""Shell patterns for names of tools."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A shell pattern as a Java regular expression for the whole text."""
    return "^(?:" + translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + r")\z" if translate(glob).startswith("(?s:") else translate(glob)


def tool_fits(tool: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | tool.rlike("(?s)" + glob_pattern(glob))
    return out
