"""Detectors: what finds entities in a text.

A detector gives the spans of one entity in a text column as an array of SPAN.
Matches don't overlap within a detector, and one that its check refuses still
uses up its text. Detectors run on the digit-normalised copy, whose offsets are
those of the text itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakstone.functions.checks import luhn_valid, verhoeff_valid
from cloakstone.functions.patterns import SPACE, UNICODE, WORD, WORD_END, WORD_START, places, slice_text

SPAN = "struct<start:int,end:int,entity_type:string,confidence:double,tier:int,detector:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(start: Column, end: Column, entity: str, confidence: Column, tier: int, detector: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(entity).alias("entity_type"), confidence.cast("double").alias("confidence"), F.lit(tier).alias("tier"), F.lit(detector).alias("detector"))


@dataclass(frozen=True)
class PatternDetector:
    """Spans where ``pattern`` matches. check(text, place) gives a match's confidence, or null to refuse it."""

    name: str
    entity_type: str
    pattern: str
    confidence: float
    check: Callable[[Column, Column], Column] | None = None
    hint: str | None = None
    """A cheap pattern without which there is no match."""
    tier: int = 1
    entities: frozenset[str] = field(default=frozenset())

    def spans(self, text: Column) -> Column:
        found = places(text, self.pattern)
        sure = self.check or (lambda t, p: F.lit(self.confidence))
        made = F.transform(found, lambda p: span(p["start"], p["end"], self.entity_type, sure(text, p), self.tier, self.name))
        if self.check:
            made = F.filter(made, lambda s: s["confidence"].isNotNull())
        return F.when(text.rlike(self.hint), made).otherwise(no_spans()) if self.hint else made


def _grouped_id(text: Column, place: Column) -> Column:
    """Twelve digits: sure by their check digit, surer in groups, refused as a part of a longer grouped number."""
    value, start, end = place["value"], place["start"], place["end"]
    gap = F.regexp_extract(value, f"{UNICODE}[{SPACE}-]", 0)
    before, after = slice_text(text, start - 2, start), slice_text(text, end, end + 2)
    longer = (F.length(before) == 2) & F.endswith(before, gap) & before.rlike(r"(?s)^\p{Nd}.$") | (F.length(after) == 2) & F.startswith(after, gap) & after.rlike(r"(?s)^.\p{Nd}$")
    return F.when(~verhoeff_valid(value), F.lit(None)).when(gap == "", F.lit(0.85)).when(longer, F.lit(None)).otherwise(F.lit(0.95))


def _card(text: Column, place: Column) -> Column:
    size = F.length(F.regexp_replace(place["value"], "[^0-9]", ""))
    return F.when(size.between(13, 19) & luhn_valid(place["value"]), F.lit(0.95))


def _quad(text: Column, place: Column) -> Column:
    return F.when(F.forall(F.split(place["value"], r"\."), lambda o: o.cast("int") <= 255), F.lit(0.9))


#: What each kind of number or address looks like.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
GAP = f"[{SPACE}-]?"
PHONE_IN = rf"{UNICODE}(?<![\d+])(?:\+91{GAP}|0)?[6-9]\d{{4}}{GAP}\d{{5}}(?!\d)"
PHONE_INTL = rf"{UNICODE}(?<!{WORD})\+\d{{1,3}}{GAP}\d{{2,4}}(?:{GAP}\d{{2,4}}){{1,3}}(?!\d)"
AADHAAR = rf"{UNICODE}(?<!\d)[2-9]\d{{3}}([{SPACE}-]?)\d{{4}}\1\d{{4}}(?!\d)"
PAN = rf"{UNICODE}{WORD_START}[A-Z]{{5}}\d{{4}}[A-Z]{WORD_END}"
IFSC = rf"{UNICODE}{WORD_START}[A-Z]{{4}}0[A-Z0-9]{{6}}{WORD_END}"
CARD = rf"{UNICODE}(?<![\d.])(?:\d{GAP}){{12,18}}\d(?![\d.])"
QUAD = rf"{UNICODE}(?<![\d.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\d.])"
#: Legal fourth letters of a PAN.
PAN_HOLDERS = list("ABCFGHLJPT")
#: Secrets: published formats of access keys and tokens; their confidences are ours.
AWS_KEY = r"(?<![A-Za-z0-9_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9_])"
GITHUB = r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})(?![A-Za-z0-9_])"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"

DETECTORS: tuple[PatternDetector, ...] = (
    PatternDetector("email", "EMAIL", EMAIL, 0.95, hint="@"),
    PatternDetector("phone_in", "PHONE", PHONE_IN, 0.9, hint="[0-9]{5}"),
    PatternDetector("phone_intl", "PHONE", PHONE_INTL, 0.7, hint=r"\+[0-9]"),
    PatternDetector("aadhaar", "AADHAAR", AADHAAR, 0.85, _grouped_id, hint="[2-9][0-9]{3}"),
    PatternDetector("pan", "PAN", PAN, 0.85, lambda t, p: F.when(F.substring(p["value"], 4, 1).isin(PAN_HOLDERS), 0.9).otherwise(0.6), hint="[A-Z]{5}[0-9]"),
    PatternDetector("ifsc", "IFSC", IFSC, 0.8, hint="[A-Z]{4}0"),
    PatternDetector("credit_card", "CREDIT_CARD", CARD, 0.95, _card, hint="[0-9]"),
    PatternDetector("ip_address", "IP_ADDRESS", QUAD, 0.9, _quad, hint=r"[0-9]\.[0-9]"),
    PatternDetector("aws_access_key", "AWS_ACCESS_KEY", AWS_KEY, 0.95, hint="A[KS]IA"),
    PatternDetector("github_token", "GITHUB_TOKEN", GITHUB, 0.95, hint="gh[pousr]_|github_pat_"),
    PatternDetector("jwt", "JWT", JWT, 0.95, hint="eyJ"),
)
BY_NAME = {d.name: d for d in DETECTORS}
