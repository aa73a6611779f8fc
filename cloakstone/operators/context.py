"""Detectors that weigh a match by the words near it, and by a list of given names.

A match has a low confidence of its own and gains 0.35 if a context word stands
within the 60 code points before it or the 30 after; confidences stay at most
0.84. Statistical recognition of names and places is a plug-in: any object with
name, entity_type, tier and spans(text), for instance over a pandas UDF, given
to Guard(extra_detectors=...).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakstone.functions.patterns import UNICODE, WORD, WORD_END, WORD_START, slice_text
from cloakstone.plans.policy import Policy

from .detectors import IFSC, PAN, PatternDetector

BEFORE, AFTER, GAIN, MOST = 60, 30, 0.35, 0.84
#: Entities that only this tier finds in free text.
ONLY_HERE = frozenset({"PERSON_NAME", "ADDRESS", "UPI_ID"})
#: Given names, whole words as written.
GIVEN_NAMES = (
    "Aarav Aditi Akash Amit Ananya Anil Anjali Arjun Asha Ayesha Deepak Devi Divya Farhan Fatima Gaurav Geeta Gopal Harish Imran Ishita Jyoti Kabir Kavita Kiran Lakshmi Lata Mahesh Manish "
    "Meera Mohan Mukesh Naveen Neha Nikhil Nisha Pooja Prakash Priya Rahul Rajesh Rakesh Ramesh Rani Ravi Rekha Rohan Sanjay Savita Seema Shreya Sita Sneha Suman Sunita Suresh Tanvi "
    "Uma Varun Vijay Vikram Vinod Yash"
).split()


def near(words: str, base: float):
    """A check that adds the gain where one of the words is near."""

    def check(text: Column, place: Column) -> Column:
        around = F.concat(slice_text(text, place["start"] - BEFORE, place["start"]), F.lit(" "), slice_text(text, place["end"], place["end"] + AFTER))
        hit = around.rlike(rf"(?iu){WORD_START}(?:{'|'.join(words.split())}){WORD_END}")
        return F.when(hit, min(MOST, round(base + GAIN, 6))).otherwise(base)

    return check


#: Shapes, base confidences and context words.
CONTEXT_DETECTORS = (
    PatternDetector("aadhaar_context", "AADHAAR", rf"{UNICODE}(?<!\d)[2-9]\d{{3}}[ -]?\d{{4}}[ -]?\d{{4}}(?!\d)", 0.3, near("aadhaar aadhar uidai uid", 0.3), hint="[2-9][0-9]{3}", tier=2),
    PatternDetector("pan_context", "PAN", PAN, 0.3, near("pan income tax itr", 0.3), hint="[A-Z]{5}[0-9]", tier=2),
    PatternDetector("ifsc_context", "IFSC", IFSC, 0.3, near("ifsc neft rtgs imps bank branch", 0.3), hint="[A-Z]{4}0", tier=2),
    PatternDetector("upi_context", "UPI_ID", rf"{UNICODE}{WORD_START}(?:{WORD}|[.-]){{2,}}@[A-Za-z]{{2,64}}{WORD_END}", 0.2, near("upi vpa gpay phonepe paytm bhim pay", 0.2), hint="@", tier=2),
    PatternDetector("given_name", "PERSON_NAME", rf"{UNICODE}{WORD_START}(?:{'|'.join(GIVEN_NAMES)}){WORD_END}", 0.65, tier=2),
)


def wanted(policy: Policy, entities: frozenset[str]) -> frozenset[str]:
    """Which of this tier's entities a policy asks for; none: the tier stays out of the plan."""
    mode, covered = policy.defaults.ner, policy.covered()
    if mode is False:
        return frozenset()
    out = entities if covered is None else entities & covered
    return frozenset() if mode == "auto" and not out & ONLY_HERE else out


def context_detectors(policy: Policy) -> list[PatternDetector]:
    """The detectors of this tier for a policy, for Guard(extra_detectors=...)."""
    want = wanted(policy, frozenset(d.entity_type for d in CONTEXT_DETECTORS))
    return [d for d in CONTEXT_DETECTORS if d.entity_type in want]


