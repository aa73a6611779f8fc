"""Entities told by the name of a column, decided while the plan is built.

The name that counts is the nearest one above the value: an array's elements
go by the array's name. For maps, whose keys are data, the same list is a
column expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE, DETECTOR = 0.6, "column_name"
#: Fixed values, the first that fits counts. The nukta of the Hindi word for phone is written both ways.
NAMES: tuple[tuple[str, str], ...] = (
    ("AADHAAR", "aadha?ar|आधार"),
    ("PAN", "pan.?(card|no|num)"),
    ("IFSC", "ifsc"),
    ("GOVT_ID", r"passport|voter.?id|ration.?card|\bssn\b|social.?security|national.?id|driving.?licen"),
    ("EMAIL", "e.?mail"),
    ("PHONE", "phone|mobile|telephone|whatsapp|contact|फ़?ोन|फ़ोन"),
    ("PERSON_NAME", "name|guardian|naam|नाम"),
    ("ADDRESS", "address|street|house.?no|pin.?code|zip.?code|postal|पता|(?<![a-z])pataa?(?![a-z])"),
    ("BANK_ACCOUNT", "account.?(no|num)|bank.?account|card.?number|खाता|(?<![a-z])khaa?ta(?![a-z])"),
    ("DOB", r"date.?of.?birth|\bdob\b|birth.?date|जन्मतिथि|jana?m\w?.?tithi"),
)
#: Words before "name" that make a technical name.
TECHNICAL = "file host tool table column schema field model repo branch package server database db index dataset pipeline chart dashboard report".split()
EXEMPT = rf"^({'|'.join(TECHNICAL)})[\s_.-]?name$"
_COMPILED = [(entity, re.compile(pattern, re.I)) for entity, pattern in NAMES]
_EXEMPT = re.compile(EXEMPT, re.I)
ENTITIES = frozenset(entity for entity, _ in NAMES)


def entity_of(name: str) -> str | None:
    """The entity that a column's name tells, if any."""
    if _EXEMPT.match(name):
        return None
    return next((entity for entity, pattern in _COMPILED if pattern.search(name)), None)


def entity_expression(name: Column) -> Column:
    """The same for names in a column; null for none."""
    java = lambda p: "(?iu)" + p.replace(r"\b", r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))").replace(r"\w", r"[\p{L}\p{N}_]")
    out = F.when(name.rlike("(?iu)" + EXEMPT.replace("$", r"\n?\z")), F.lit(None).cast("string"))
    for entity, pattern in NAMES:
        out = out.when(name.rlike(java(pattern)), entity)
    return out
