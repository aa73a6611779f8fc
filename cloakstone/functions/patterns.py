"""Regular expressions with one meaning for letters, digits and white space, and spans found by them.

Patterns are written for Spark's Java engine. WORD is any letter or number of
any script and the underscore; SPACE also holds the separators U+001C-U+001F.
Offsets count code points: the engine's own offsets (UTF-16) are never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
SPACE = r"\s\x1c-\x1f"
UNICODE = "(?U)"

MARK, PLAIN = "\x01", "\x02"
PLACE = "struct<start:int,end:int,value:string>"


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, left to right, offsets in code points.

    The matches are set between marks, the text is cut at the marks, and the
    running length of the pieces gives the offsets.
    """
    marked = F.regexp_replace(F.translate(text, MARK, PLAIN), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{PLACE}>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("value")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(f"array<{PLACE}>")
    return F.when(text.rlike(pattern), F.aggregate(F.split(marked, MARK, -1), start, step, lambda acc: acc["found"])).otherwise(none)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points start (from 0) to end of a text; beyond its ends there is nothing."""
    return F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))
